"""Point operations on any table, in bulk: a table of keys answers for one key or a billion."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join


def get_by_key(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose primary key is asked for, and the asked keys that no row has."""
    asked = keys.select(key).distinct()
    found = lookup_join(df, asked, key, key, "left_semi", unique=True)
    return found, missing_keys(df, keys, key)


def missing_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Distinct asked keys without a row; ``key`` is the primary key of the table."""
    held = df.select(F.col(key).alias("_held"))
    asked = keys.select(key).distinct()
    return asked.join(held, F.col(key) == F.col("_held"), "left_anti")


def exists_key(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The asked rows plus ``exists``: whether the table has their key, its primary key."""
    held = df.select(F.col(key).alias("_held"), F.lit(True).alias("_hit"))
    flagged = lookup_join(keys, held, key, "_held")
    return flagged.select(*keys.columns, F.coalesce("_hit", F.lit(False)).alias("exists"))


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without those whose primary key is asked for, and the asked keys no row has."""
    asked = keys.select(key).distinct()
    kept = lookup_join(df, asked, key, key, "left_anti", unique=True)
    return kept, missing_keys(df, keys, key)


def next_id(df: DataFrame, key: str = "id") -> Column:
    """Highest key in use, 0 for an empty table, as a scalar subquery."""
    return df.select(F.coalesce(F.max(key), F.lit(0).cast("long"))).scalar()
