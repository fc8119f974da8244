"""Collection analytics on Spark: catalog, holdings, imports, snapshots and grid queries."""
