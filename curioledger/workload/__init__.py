"""The registered queries over the given star-schema tables, and the SQL that checks them."""
