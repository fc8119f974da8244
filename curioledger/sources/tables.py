"""Stored tables: full scans, versioned writes and the snapshot table."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType, TimestampNTZType

from ..operators.snapshots import IDENTITY_KEY, identity_key, total_value_by_snapshot
from ..plans.joins import lookup_join
from ..plans.lineage import shuffles_dropped
from ..schemas import TABLES


# The totals kept beside snapshots; money sums are as wide as Spark makes them.
TOTALS = StructType(
    [StructField("total_value", DecimalType(33, 2)), StructField("snapshot_ts", TimestampNTZType())]
)


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Full scan of ``catalog_sets``, ``holdings`` or ``holding_snapshots`` below ``root``."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def scan_jdbc(
    spark: SparkSession, name: str, url: str, key: str, low: int, high: int, tasks: int, **options
) -> DataFrame:
    """Full scan of a table kept in a database, read in ``tasks`` ranges of a numeric key."""
    loaded = spark.read.jdbc(
        url, name, column=key, lowerBound=low, upperBound=high, numPartitions=tasks,
        properties=options,
    )
    return loaded.to(TABLES[name])


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Store a table in its declared column order and types.

    A table must not be overwritten from a plan that still reads it: write a new root instead.
    """
    rows = df.to(TABLES[name])
    writer = rows.write.mode(mode)
    if name == "holding_snapshots":
        writer = writer.partitionBy("snapshot_ts")
    writer.parquet(f"{root}/{name}")


def append_snapshot(rows: DataFrame, root: str) -> None:
    """Add the rows of a snapshot as a partition of their own.

    The partition is put in place as a whole, so that an append that is run again, after the driver
    was lost or for any other reason, leaves one copy. The snapshot's second must be its own, which
    ``create_snapshot`` sees to.
    """
    stamped = rows.to(TABLES["holding_snapshots"]).write.mode("overwrite")
    stamped = stamped.option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts")
    with shuffles_dropped(rows.sparkSession):
        stamped.option("compression", "zstd").parquet(f"{root}/holding_snapshots")


def stored_totals(spark: SparkSession, root: str) -> DataFrame:
    """The totals kept beside the snapshots below ``root``; none before the first refresh."""
    try:
        return spark.read.schema(TOTALS).parquet(f"{root}/snapshot_totals")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TOTALS)


def refresh_totals(snapshots: DataFrame, root: str) -> DataFrame:
    """Value of every snapshot, oldest first, as ``total_value_by_snapshot`` has it, by totals kept.

    A stored snapshot never changes, so its total is computed once: only the partitions of
    snapshots that have none yet are read. Totals are put in place by snapshot, so a refresh that is
    run again leaves one of each; those of deleted snapshots stay in store and out of the result.
    """
    spark = snapshots.sparkSession
    held = snapshots.select("snapshot_ts").distinct()
    known = stored_totals(spark, root)
    fresh = lookup_join(held, known.select("snapshot_ts"), "snapshot_ts", "snapshot_ts", "left_anti")
    new = [r["snapshot_ts"] for r in fresh.collect()]
    if new:
        # As literals the seconds prune partitions; what is new is a few snapshots, or all of them.
        some = snapshots if known.isEmpty() else snapshots.filter(F.col("snapshot_ts").isin(new))
        totals = total_value_by_snapshot(some).select("total_value", "snapshot_ts")
        totals = totals.to(TOTALS).coalesce(1).write.mode("overwrite")
        totals = totals.option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts")
        totals.parquet(f"{root}/snapshot_totals")
    every = stored_totals(spark, root)
    kept = lookup_join(every, held, "snapshot_ts", "snapshot_ts", "left_semi", unique=True)
    return kept.select("snapshot_ts", "total_value").orderBy("snapshot_ts")


def _declare_buckets(spark: SparkSession, root: str, table: str, buckets: int) -> DataFrame:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES["holding_snapshots"]]
    columns.append(f"`{IDENTITY_KEY}` string")
    if not spark.catalog.tableExists(table):
        spark.sql(
            f"create table `{table}` ({', '.join(columns)}) using parquet"
            f" options (path '{root}/bucketed_snapshots', partitionOverwriteMode 'dynamic')"
            f" partitioned by (snapshot_ts) clustered by (`{IDENTITY_KEY}`) into {int(buckets)} buckets"
        )
    return spark.table(table)


def bucketed_snapshots(spark: SparkSession, root: str, table: str, buckets: int) -> DataFrame:
    """The snapshots stored below ``root`` in buckets of card identity, as a table of the session.

    The session's catalog is told of the files, so a new session finds what an earlier one stored.
    The number of buckets must be that of the first append.
    """
    _declare_buckets(spark, root, table, buckets)
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def append_bucketed_snapshot(rows: DataFrame, root: str, table: str, buckets: int) -> DataFrame:
    """Add snapshots to the bucketed table and return that table.

    One shuffle by identity when a snapshot is stored, once and for all, takes the place of two at
    every comparison. Tasks are dealt whole buckets of a snapshot, and parts of those that are too
    large for one. Run again it leaves one copy, like :func:`append_snapshot`. Buckets are read whole, so a card that holds a large part of all rows is better compared without them.
    """
    spark = rows.sparkSession
    stored = _declare_buckets(spark, root, table, buckets)
    keyed = rows.to(TABLES["holding_snapshots"]).withColumn(IDENTITY_KEY, identity_key())
    bucket = F.pmod(F.hash(IDENTITY_KEY), F.lit(buckets))
    dealt = keyed.withColumn("_bucket", bucket).hint("rebalance", "_bucket", "snapshot_ts")
    dealt.select(stored.columns).write.mode("overwrite").insertInto(table)
    return bucketed_snapshots(spark, root, table, buckets)
