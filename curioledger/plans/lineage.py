"""Cutting lineage into storage that outlives an executor."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a large table that are shuffled at a time.
PART_ROWS = 25_000_000

# A write whose shuffles nothing can use again drops their files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def own_folder_if_local(spark: SparkSession) -> None:
    """Name a folder for a local session that has none; callers decide, operators never do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="curioledger-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a session without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder and go on from there.

    Later uses see the very same rows, survive lost executors without recomputing them, and read
    only the columns they need. Row order is not kept.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files at their end, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def write_compact(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write an intermediate table, densely packed; the shuffles behind it are dropped."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path)


def settle_compact(df: DataFrame) -> DataFrame:
    """:func:`settle` for large tables: densely packed, and the shuffles behind it are dropped."""
    path = scratch_path(df.sparkSession, "settled")
    write_compact(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(rows: DataFrame) -> int:
    """Parts that a settled table is taken in, so that none has many more than ``PART_ROWS`` rows."""
    return max(1, ceil(rows.count() / PART_ROWS))


def settle_by_parts(
    rows: DataFrame, key: str, step: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]
) -> DataFrame:
    """Settle what ``step`` makes of a settled table, the parts of it one after another.

    Rows are parted by a hash of ``key``. ``step`` gets a function that cuts any table with that column
    down to the part at hand, and its result for the whole must be that of its parts put together. Only
    the shuffles of one part lie on disk at a time.
    """
    parts, path = parts_of(rows), scratch_path(rows.sparkSession, "settled")
    for number in range(parts):
        # A seed of its own: the part says nothing of the place in a later shuffle by the same key.
        mine = F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)) == number
        part = step(lambda df: df.filter(mine) if parts > 1 else df)
        write_compact(part, path, "append")
    return rows.sparkSession.read.schema(part.schema).parquet(path)
