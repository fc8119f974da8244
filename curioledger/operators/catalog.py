"""The dimension of sets: feed projection, upsert, create, update, delete, search."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import safe_date
from ..functions.text import form_trim, is_blank
from ..schemas import CATALOG_SETS
from .keyed import delete_rows

COLUMNS = CATALOG_SETS.names
# A manual update sets every column but the key and the icon.
EDITABLE = [name for name in COLUMNS if name not in ("set_code", "icon_svg_uri")]


def project_sets(feed: DataFrame) -> DataFrame:
    """Feed shape to table shape; ``feed_seq`` is kept when the feed has one."""
    extra = [c for c in ("feed_seq",) if c in feed.columns]
    return feed.select(
        F.col("code").alias("set_code"),
        F.col("name").alias("set_name"),
        safe_date("released_at").alias("release_date"),
        "set_type",
        "card_count",
        "printed_size",
        "block_code",
        F.col("block").alias("block_name"),
        "icon_svg_uri",
        *extra,
    )


def upsert_sets(sets: DataFrame, feed: DataFrame) -> DataFrame:
    """Overwrite whole rows by code, nulls included; the last of repeated codes wins."""
    incoming = project_sets(feed).filter(F.col("set_code").isNotNull())
    stored = sets.withColumn("feed_seq", F.lit(None).cast(feed.schema["feed_seq"].dataType))
    # Nulls come first, so a stored row stands only where the feed has none.
    place = F.struct(F.col("feed_seq").isNotNull().alias("fed"), F.col("feed_seq"))
    both = incoming.unionByName(stored.select(*COLUMNS, "feed_seq"))
    last = both.groupBy(F.col("set_code").alias("_code")).agg(
        F.max_by(F.struct(*COLUMNS), place).alias("_row")
    )
    return last.select("_row.*")


def clean_set_input(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trim and null-out form text, read dates; rows without code or name are turned away."""
    texts = ("set_type", "block_code", "block_name")
    numbers = ("card_count", "printed_size")
    others = [
        c
        for c in requests.columns
        if c not in (*texts, *numbers, "set_code", "set_name", "release_date")
    ]
    cleaned = requests.select(
        *others,
        *[F.coalesce(form_trim(c), F.lit("")).alias(c) for c in ("set_code", "set_name")],
        *[F.nullif(form_trim(c), F.lit("")).alias(c) for c in texts],
        safe_date(form_trim("release_date")).alias("release_date"),
        *[form_trim(F.col(c).cast("string")).try_cast("int").alias(c) for c in numbers],
    ).select(requests.columns)
    complete = (F.col("set_code") != "") & (F.col("set_name") != "")
    return cleaned.filter(complete), cleaned.filter(~complete)


def create_set(sets: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert new codes; a code in the table, or asked for earlier, is a conflict."""
    first = requests.groupBy(F.col("set_code").alias("_code")).agg(
        F.min("req_seq").alias("_seq")
    )
    fresh = first.join(sets.select(F.col("set_code").alias("_code")), "_code", "left_anti")
    # The pair below is unique, so no task gets a popular code to itself.
    accepted = (F.col("set_code") == F.col("_code")) & (F.col("req_seq") == F.col("_seq"))
    added = requests.join(fresh, accepted, "left_semi").withColumn(
        "icon_svg_uri", F.lit(None).cast("string")
    )
    conflicts = requests.join(fresh, accepted, "left_anti")
    return sets.select(COLUMNS).unionByName(added.select(COLUMNS)), conflicts


def update_set(sets: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace everything but the icon where path and body name the same, known code."""
    named = F.col("path_code").eqNullSafe(F.col("set_code"))
    valid = requests.filter(named)
    last = valid.groupBy(F.col("set_code").alias("_code")).agg(
        F.max_by(F.struct(*EDITABLE), "req_seq").alias("_new")
    )
    joined = sets.join(last, F.col("set_code") == F.col("_code"), "left")
    replaced = {
        c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
        for c in EDITABLE
    }
    updated = joined.withColumns(replaced).select(COLUMNS)

    held = sets.select(F.col("set_code").alias("_code"))
    mismatched = requests.filter(~named).withColumn("reason", F.lit("code_mismatch"))
    unknown = valid.join(held, F.col("set_code") == F.col("_code"), "left_anti").withColumn(
        "reason", F.lit("not_found")
    )
    return updated, mismatched.unionByName(unknown)


def delete_set(sets: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets that stay, and asked codes that are unknown; holdings are left alone."""
    return delete_rows(sets, codes, "set_code")


def search_sets(sets: DataFrame, query: str | None) -> DataFrame:
    """Sets whose name or code contains the text; a blank text finds all."""
    text = (query or "").strip().lower()
    if not text:
        return sets
    return sets.filter(
        F.lower("set_name").contains(text) | F.lower("set_code").contains(text)
    )


def filter_sets(
    sets: DataFrame,
    set_code: str = "",
    set_name: str = "",
    release_date: str = "",
    set_type: str = "",
    card_count: int | None = None,
    printed_size: int | None = None,
    block_code: str = "",
    block_name: str = "",
    editing: bool = False,
) -> DataFrame:
    """Every filled-in field narrows the rows; while a set is being edited none does."""
    if editing:
        return sets
    texts = {
        "set_code": set_code,
        "set_name": set_name,
        "set_type": set_type,
        "block_code": block_code,
        "block_name": block_name,
    }
    tests = [
        F.lower(c).contains(text.strip().lower())
        for c, text in texts.items()
        if text and text.strip()
    ]
    if release_date and release_date.strip():
        tests.append(F.col("release_date") == safe_date(F.lit(release_date.strip())))
    for c, number in (("card_count", card_count), ("printed_size", printed_size)):
        if number is not None and number > 0:
            tests.append(F.col(c) == number)
    return sets.filter(reduce(lambda a, b: a & b, tests)) if tests else sets


def icon_worklist(sets: DataFrame, cached: DataFrame) -> DataFrame:
    """Icons to fetch: sets with a location whose ``<code>.svg`` is not among ``object_key``."""
    wanted = sets.filter(~is_blank("icon_svg_uri")).select(
        "set_code", F.concat("set_code", F.lit(".svg")).alias("object_key"), "icon_svg_uri"
    )
    return wanted.join(cached.select("object_key"), "object_key", "left_anti").select(
        "set_code", "object_key", "icon_svg_uri"
    )
