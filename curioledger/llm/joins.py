"""Joins that adaptive execution can split when one key is hot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows``, whose key may be hot, to ``side``, which has one row per key.

    The comparison is null-safe: null matches null, and each side gets a shuffle of its own even
    when it comes out of an aggregate on the key. That is the shape in which adaptive execution
    splits a hot key over many tasks, and in which it broadcasts a side it has seen to be small.
    """
    other = "side_key"
    while other in rows.columns or other in side.columns:
        other += "_"
    side = side.withColumnRenamed(key, other)
    joined = rows.join(side, F.col(key).eqNullSafe(F.col(other)), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(other)


def dealt_by_key(keyed: DataFrame, item: str, block_rows: int) -> DataFrame:
    """``keyed`` with its tasks ``(key, a, b)``, shuffled and sorted by them.

    All rows of a key meet in its one task. A key with more than ``block_rows`` rows is cut into
    chunks by a hash of the item, and chunk c meets every other chunk in a task of its own.
    """
    many = keyed.groupBy("key").agg(F.count("*").alias("rows"))
    many = many.filter(F.col("rows") > block_rows)
    many = many.select("key", F.ceil(F.col("rows") / block_rows).cast("int").alias("chunks"))
    sized = spread_join(keyed, many, "key", "left")
    chunk = F.pmod(F.xxhash64(item), F.col("chunks")).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != chunk)
    meets = F.transform(
        others, lambda c: F.struct(F.least(c, chunk).alias("a"), F.greatest(c, chunk).alias("b"))
    )
    tasks = F.when(F.col("chunks") > 1, meets).otherwise(whole)
    rest = [c for c in keyed.columns if c != "key"]
    dealt = sized.select("key", *rest, F.explode(tasks).alias("t")).select("key", "t.a", "t.b", *rest)
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
