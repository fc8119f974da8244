"""Landed JSON feeds, read with fixed schemas.

Every reader adds ``feed_seq``, an orderable struct giving the place of a record in its feed
(file, block, line, array index), because later steps keep the first or the last of duplicates.
What is no record of the schema is lost to none of them: each reader also returns the broken lines,
or whole files with ``multi_line``, as ``file, text``.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import BATCH_REPLY, FEED_CARD, GRID, SET_LIST

BROKEN = "_corrupt_record"


def _placed(lines: DataFrame) -> DataFrame:
    return lines.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def _read_json(
    spark: SparkSession, path, schema: StructType, multi_line: bool
) -> tuple[DataFrame, DataFrame]:
    """Records with their place, and what is broken."""
    full = StructType([*schema.fields, StructField(BROKEN, StringType())])
    lines = spark.read.schema(full).json(
        path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN
    )
    placed = _placed(lines)
    # A plan that reads nothing but the broken text is not allowed, hence the look at a field.
    looked = F.coalesce(F.length("object"), F.lit(0)) >= 0
    broken = placed.filter(F.col(BROKEN).isNotNull() & looked)
    good = placed.filter(F.col(BROKEN).isNull()).drop(BROKEN)
    return good, broken.select(F.col("_file").alias("file"), F.col(BROKEN).alias("text"))


class Landed(NamedTuple):
    """A feed parsed once: its records, what is broken, and how many there are of each."""

    records: DataFrame
    broken: DataFrame
    record_count: int
    broken_count: int


def land_feed(
    spark: SparkSession, path, schema: StructType, root: str, multi_line: bool = False
) -> Landed:
    """Parse a feed once and store records and broken lines apart below ``root``.

    Both come out of one scan, and their numbers are observed while they are written. Records keep
    their place as ``_file, _block, _line``, which the readers' ``feed_seq`` is made of.
    """
    full = StructType([*schema.fields, StructField(BROKEN, StringType())])
    lines = spark.read.schema(full).json(
        path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN
    )
    placed = _placed(lines).withColumn("is_broken", F.col(BROKEN).isNotNull())
    seen = Observation("feed")
    counts = [F.count_if(~F.col("is_broken")).alias("records"), F.count_if("is_broken").alias("broken")]
    placed.observe(seen, *counts).write.partitionBy("is_broken").parquet(root)
    stored = spark.read.schema(StructType([*placed.schema.fields])).parquet(root)
    records = stored.filter(~F.col("is_broken")).drop(BROKEN, "is_broken")
    broken = stored.filter("is_broken").select(F.col("_file").alias("file"), F.col(BROKEN).alias("text"))
    return Landed(records, broken, seen.get["records"], seen.get["broken"])


def land_card_feed(spark: SparkSession, path, root: str, multi_line: bool = False) -> Landed:
    """:func:`read_card_feed` by one scan: cards with their place, and what is broken."""
    landed = land_feed(spark, path, FEED_CARD, root, multi_line)
    place = F.struct("_file", "_block", "_line").alias("feed_seq")
    return landed._replace(records=landed.records.select(*FEED_CARD.names, place))


def land_sets_feed(spark: SparkSession, path, root: str, multi_line: bool = True) -> Landed:
    """:func:`read_sets_feed` by one scan; the counts are those of envelopes."""
    landed = land_feed(spark, path, SET_LIST, root, multi_line)
    return landed._replace(records=_items(landed.records, "data"))


def land_batch_replies(
    spark: SparkSession, path, root: str, multi_line: bool = False
) -> tuple[Landed, DataFrame]:
    """:func:`read_batch_replies` by one scan: cards and what is broken, and identifiers not found."""
    landed = land_feed(spark, path, BATCH_REPLY, root, multi_line)
    return landed._replace(records=_items(landed.records, "data")), _items(landed.records, "not_found")


def _items(replies: DataFrame, array: str) -> DataFrame:
    place = ["_file", "_block", "_line"]
    exploded = replies.select(*place, F.posexplode(array).alias("_item_no", "_item"))
    return exploded.filter(F.col("_item").isNotNull()).select(
        "_item.*", F.struct(*place, "_item_no").alias("feed_seq")
    )


def read_sets_feed(
    spark: SparkSession, path, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Sets of one or more list envelopes, and what is broken; an envelope may be without data."""
    replies, broken = _read_json(spark, path, SET_LIST, multi_line)
    return _items(replies, "data"), broken


def read_card_feed(
    spark: SparkSession, path, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Card objects, one per line, or one per file with ``multi_line``, and what is broken."""
    cards, broken = _read_json(spark, path, FEED_CARD, multi_line)
    place = F.struct("_file", "_block", "_line").alias("feed_seq")
    return cards.select(*FEED_CARD.names, place), broken


def read_batch_replies(
    spark: SparkSession, path, multi_line: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched cards and not-found identifiers of many batch replies, and what is broken."""
    replies, broken = _read_json(spark, path, BATCH_REPLY, multi_line)
    return _items(replies, "data"), _items(replies, "not_found"), broken


def read_grid(spark: SparkSession, path, fmt: str = "parquet", **options) -> DataFrame:
    """All rows of all sheets; ``fmt`` is any file format that takes a schema."""
    return spark.read.format(fmt).schema(GRID).options(**options).load(path)
