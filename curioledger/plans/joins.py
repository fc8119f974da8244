"""Equi-join of a large, possibly skewed table to a side with one row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks that the rows of one key are dealt over where the keys are few.
SPREAD = 64

# Keys at most that are looked up inside the plan instead of by a shuffle.
FEW = 64


def lookup_join(
    rows: DataFrame,
    side: DataFrame,
    row_key: str,
    side_key: str,
    how: str = "left",
    unique: bool = False,
    spread: str | None = None,
) -> DataFrame:
    """Join ``rows`` to ``side``, whose key is unique and not null; the side's key is dropped.

    Nothing is measured while the plan is built: adaptive execution broadcasts a side whose shuffle
    it has seen to be small (``spark.sql.adaptive.autoBroadcastJoinThreshold``). Otherwise both
    sides are shuffled on the key. The null-safe comparison gives the side a shuffle of its own even
    when it comes out of an aggregate on that key, and that is the shape in which adaptive execution
    splits a hot key over many tasks. Where the key is ``unique`` in the rows too, nothing can be
    hot and the side's own partitioning is kept.

    Few keys of many rows leave most tasks without a row, and there nothing is broadcast. ``spread``
    names a column that differs within a key: its hash deals the rows of each key over ``SPREAD``
    tasks, and the side, which must be narrow, is repeated for all of them.
    """
    keyed = side.filter(F.col(side_key).isNotNull()).withColumnRenamed(side_key, "_side_key")
    ours, theirs = F.col(row_key), F.col("_side_key")
    matched = ours == theirs if unique else ours.eqNullSafe(theirs)
    if spread is not None:
        rows = rows.withColumn("_deal", F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
        deals = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
        keyed = keyed.withColumn("_side_deal", deals)
        matched = matched & (F.col("_deal") == F.col("_side_deal"))
        return rows.join(keyed, matched, how).drop("_deal", "_side_deal", "_side_key")
    joined = rows.join(keyed, matched, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_side_key")


def flag_members(
    rows: DataFrame, members: DataFrame, key: str, flag: str, spread: str
) -> DataFrame:
    """Add ``flag``: whether a row's key is among those of ``members``, which are distinct.

    Up to ``FEW`` members are computed inside the plan and looked up where the rows lie. Only where
    there are more does the other branch get rows: it joins them by :func:`lookup_join`. A null key is
    never a member.
    """
    known = members.filter(F.col(key).isNotNull()).select(key)
    listed = known.limit(FEW + 1).agg(F.collect_list(key).alias("_listed"))
    few = listed.select(F.when(F.size("_listed") <= FEW, F.col("_listed"))).scalar()
    found = F.coalesce(F.array_contains(few, F.col(key)), F.lit(False))
    here = rows.filter(few.isNotNull()).withColumn(flag, found)
    joined = lookup_join(rows.filter(few.isNull()), known.withColumn("_member", F.lit(True)), key, key, spread=spread)
    return here.unionByName(joined.withColumn(flag, F.coalesce("_member", F.lit(False))).drop("_member"))
