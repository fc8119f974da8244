"""A uniform shuffle into shards of exact sizes.

How many rows each partition sends to each shard is drawn first: a matrix whose row sums are the
partition sizes and whose column sums are the shard sizes, by multivariate hypergeometric draws. A
partition then permutes its own shard labels and deals them to its rows, the rows are exchanged, and
every shard is permuted again by random keys. Any row may end in any place of any shard, and shards
differ by one row at most.

A shard is not one task: its random keys cut it into chunks of like size, whose counts give each
chunk its first slot.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.lineage import scratch_path, settle

SHARDS = 16
CHUNK_ROWS = 65_536
SEED = 10
KEYS = 1 << 52


def communication_matrix(sizes: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows that each partition sends to each shard; shard sizes differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    matrix = np.zeros((len(sizes), shards), np.int64)
    for k, size in enumerate(sizes):
        matrix[k] = rng.multivariate_hypergeometric(room, size, method="marginals")
        room -= matrix[k]
    return matrix


def _dealer(matrix, seed: int):
    """Deal each partition's shard labels, permuted, to its rows, with a random key for the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        own = matrix.value.get(part, np.zeros(0, np.int64))
        labels = np.repeat(np.arange(len(own), dtype=np.int32), own)
        rng.shuffle(labels)
        at = 0
        for batch in batches:
            end = at + batch.num_rows
            keys = rng.integers(0, KEYS, batch.num_rows)
            columns = [*batch.columns, pa.array(labels[at:end]), pa.array(keys)]
            names = [*batch.schema.names, "_shard", "_key"]
            at = end
            if at > len(labels):
                break
            yield pa.RecordBatch.from_arrays(columns, names)
        if at != len(labels):
            raise RuntimeError(f"partition {part} has other rows than were counted")

    return run


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns, with the ``shard`` and the ``slot`` in it that a uniform shuffle gives.

    Shard sizes differ by one at most; slots are gapless from 0. Null values, repeated rows and
    rows of any length are dealt alike; an empty table gives no rows; columns named ``shard`` or
    ``slot`` are replaced. The same stored rows and seed give the same places.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "unshuffled")
    rows = rows.drop("shard", "slot")
    columns = rows.columns
    # The table's columns travel as one, so none of theirs can clash with ours.
    rows = rows.select(F.struct(*[rows[c] for c in columns]).alias("row"))
    rows.write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    counted = stored.groupBy(F.spark_partition_id().alias("part")).count().collect()
    sizes = {r["part"]: r["count"] for r in counted}
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    shared = spark.sparkContext.broadcast(dict(zip(parts, matrix, strict=True)))
    kinds = T.StructType([*rows.schema, T.StructField("_shard", T.IntegerType()), T.StructField("_key", T.LongType())])
    dealt = settle(stored.mapInArrow(_dealer(shared, seed), kinds))

    chunks = max(1, -(-sum(sizes.values()) // (shards * CHUNK_ROWS)))
    dealt = dealt.withColumn("_chunk", F.floor(F.col("_key") / F.lit(-(-KEYS // chunks))).cast("long"))
    counts = dealt.groupBy("_shard", "_chunk").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    bases = counts.select(F.col("_shard").alias("_s"), F.col("_chunk").alias("_c"), first.alias("_first"))
    inside = Window.partitionBy("_shard", "_chunk").orderBy("_key")
    placed = dealt.withColumn("_place", F.row_number().over(inside))
    same = (F.col("_shard") == F.col("_s")) & (F.col("_chunk") == F.col("_c"))
    slot = (F.col("_first") + F.col("_place") - 1).cast("long")
    own = [F.col("row").getField(c).alias(c) for c in columns]
    return placed.join(bases, same).select(*own, F.col("_shard").alias("shard"), slot.alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of ``docs(doc_id, text)``.

    The law is ``rows``: counts per shard differ by one at most. Size is the text's UTF-8 bytes and
    one; a null text has none, and the checksum of an empty one. Other columns are not read.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(data) + 1).cast("long")
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(data).alias("text_crc32"))
    return shuffled(narrow, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
