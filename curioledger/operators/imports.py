"""Grid import: normalise rows, resolve sets and cards, persist, report."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cards import name_key, number_key
from ..functions.parsing import cell_decimal, cell_text, foil_flag, manual_flag, parse_quantity, pick_price
from ..functions.text import blank_to_null, cell_trim, is_blank, norm
from ..plans.joins import flag_members, lookup_join
from ..plans.lineage import settle, settle_by_parts
from ..plans.ordering import number_by
from ..schemas import GRID, GRID_COLUMNS, HOLDINGS, NUMBER_COLUMNS
from .catalog import project_sets
from .keyed import next_id
from .lookups import match_feed

# The layout of an importable sheet.
HEADER_ROW = 3
FIRST_DATA_ROW = 4
HEADER_TITLES = {"a": "number (optional)", "b": "card", "c": "set", "d": "foil"}

SET_NOT_FOUND = "set_not_found"
NO_NAME_OR_NUMBER = "no_name_or_number"
CARD_NOT_FOUND = "card_not_found"
CARD_NAME_BLANK = "card_name_blank"
LOOKUP_FAILED = "feed_lookup_failed"
SET_SYNC_FAILED = "set_sync_failed"


def matching_names(grid: DataFrame) -> DataFrame:
    """Sheets whose header row carries the expected titles.

    The header row is a pushed-down filter, so reading the list skips whatever holds no header; it
    is part of the plan that uses it, and nothing runs until that does.
    """
    titled = F.col("row_no") == HEADER_ROW
    for letter, title in HEADER_TITLES.items():
        titled = titled & (F.lower(cell_trim(letter)) == title)
    return grid.filter(titled).select("sheet").distinct()


def _is_data_row():
    return (F.col("row_no") >= FIRST_DATA_ROW) & ~(is_blank("b") & is_blank("c"))


def matching_sheets(grid: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Rows of the sheets named, by default those with the expected header row.

    Rows are told where they lie while the sheets are few; where they are many, the rows of each are
    dealt out by their numbers.
    """
    names = matching_names(grid) if names is None else names
    flagged = flag_members(grid, names, "sheet", "_imported", spread="row_no")
    return flagged.filter("_imported").drop("_imported")


def data_rows(grid: DataFrame) -> DataFrame:
    """Rows below the header with a card or a set."""
    return grid.filter(_is_data_row())


def normalize_grid(rows: DataFrame) -> DataFrame:
    """Name the columns and type the cells: foil, quantity, manual flag, set key, row reference."""
    text = {letter: f"{name}_text" for letter, name in GRID_COLUMNS.items()}
    for letter, name in zip("bijk", ("card", "comment", "language", "location")):
        text[letter] = name
    return rows.select(
        "sheet",
        "row_no",
        *[F.col(letter).alias(name) for letter, name in text.items()],
        *[F.col(f"{c}_num").alias(f"{GRID_COLUMNS[c]}_num") for c in NUMBER_COLUMNS],
        cell_text("a", "a_num").alias("number"),
        foil_flag("d").alias("foil"),
        parse_quantity("f", "f_num").alias("quantity"),
        manual_flag("i").alias("manual"),
        norm("c").alias("set_key"),
        F.concat_ws("!", "sheet", "row_no").alias("row_ref"),
    )


def resolve_set(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``set_code`` by normalised set name; of sets sharing a name the last code wins."""
    by_name = (
        sets.filter(F.col("set_name").isNotNull())
        .groupBy(norm("set_name").alias("_name"))
        .agg(F.max("set_code").alias("set_code"))
    )
    return lookup_join(rows, by_name, "set_key", "_name")


def build_match_keys(rows: DataFrame) -> DataFrame:
    """Add ``match_key``; null for manual rows, unknown sets and rows with nothing to look up."""
    key = F.when(~is_blank("number"), number_key("set_code", "number")).when(
        ~is_blank("card"), name_key("set_code", "card")
    )
    looked_up = F.col("set_code").isNotNull() & ~F.col("manual")
    return rows.withColumn("match_key", F.when(looked_up, key))


def lookup_identifiers(rows: DataFrame) -> DataFrame:
    """Identifiers of the rows to look up, in the shape their key has, with their grid place."""
    by_number = ~is_blank("number")
    return rows.filter(F.col("match_key").isNotNull()).select(
        "sheet",
        "row_no",
        F.when(~by_number, F.col("card")).alias("name"),
        F.col("set_code").alias("set"),
        F.when(by_number, F.col("number")).alias("collector_number"),
    )


def enrich(rows: DataFrame, feed: DataFrame | None) -> DataFrame:
    """Add type, price, number and ``reason`` (null when resolved).

    Manual rows keep what the grid says. ``feed=None`` stands for a failed feed lookup: every
    row that needs a card is then not found.
    """
    if feed is None:
        empty = {"feed_number": "string", "feed_type": "string", "feed_usd": "string"}
        empty |= {"feed_usd_foil": "string"}
        found = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in empty.items()})
        found = found.withColumn("feed_hit", F.lit(False))
    else:
        found = match_feed(rows, "match_key", feed)
    manual = F.col("manual")
    reason = (
        F.when(manual, F.lit(None))
        .when(F.col("set_code").isNull(), SET_NOT_FOUND)
        .when(F.col("match_key").isNull(), NO_NAME_OR_NUMBER)
        .when(~F.col("feed_hit"), CARD_NOT_FOUND)
    )
    price = pick_price("foil", "feed_usd", "feed_usd_foil")
    return found.select(
        *rows.columns,
        F.when(manual, F.col("type_text")).otherwise(F.col("feed_type")).alias("card_type"),
        F.when(manual, cell_decimal("price_text", "price_num")).otherwise(price).alias("price"),
        F.when(F.col("feed_hit") & is_blank("number"), F.col("feed_number"))
        .otherwise(F.col("number"))
        .alias("card_number"),
        reason.alias("reason"),
    )


def resolve_grid(
    grid: DataFrame, sets: DataFrame, feed: DataFrame | None, names: DataFrame | None = None
) -> DataFrame:
    """The whole chain from raw grid to classified rows."""
    rows = normalize_grid(data_rows(matching_sheets(grid, names)))
    return enrich(build_match_keys(resolve_set(rows, sets)), feed)


def resolve_by_parts(
    grid: DataFrame, sets: DataFrame, feed: DataFrame | None, names: DataFrame | None = None
) -> DataFrame:
    """What :func:`resolve_grid` returns, settled, for a settled grid of any size.

    Rows are resolved one by one, so the grid is taken in parts and the shuffles of one part alone lie
    on disk; the sheets are those of the whole grid.
    """
    names = matching_names(grid) if names is None else names
    return settle_by_parts(grid, "row_no", lambda mine: resolve_grid(mine(grid), sets, feed, names))


def unresolved_rows(resolved: DataFrame) -> DataFrame:
    """Rows without a card; null texts show as empty."""
    texts = {"number": "number", "card": "card", "set": "set_text", "foil": "foil_text"}
    return resolved.filter(F.col("reason").isNotNull()).select(
        "sheet",
        "row_no",
        *[F.coalesce(c, F.lit("")).alias(name) for name, c in texts.items()],
        "reason",
    )


def unresolved_report(resolved: DataFrame) -> DataFrame:
    """Rows without a card, in grid order."""
    return unresolved_rows(resolved).orderBy("sheet", "row_no")


def _errors():
    failed = F.when(F.col("reason").isin(SET_NOT_FOUND, NO_NAME_OR_NUMBER), F.col("reason"))
    nameless = F.when(is_blank("card"), F.lit(CARD_NAME_BLANK))
    return F.array_compact(F.array(failed, nameless))


def job_errors(feed_failed: bool, sets_failed: bool) -> list[str]:
    """Errors of the job as a whole, each there at most once."""
    failed = ((SET_SYNC_FAILED, sets_failed), (LOOKUP_FAILED, feed_failed))
    return [error for error, happened in failed if happened]


def import_errors(
    resolved: DataFrame, feed_failed: bool = False, sets_failed: bool = False
) -> DataFrame:
    """One row per error: grid reference, null for those of the whole job, and error code."""
    own = resolved.select("row_ref", F.explode(_errors()).alias("error"))
    rows = [(None, error) for error in job_errors(feed_failed, sets_failed)]
    whole = resolved.sparkSession.createDataFrame(rows, "row_ref string, error string")
    return own.unionByName(whole) if rows else own


def import_metrics(
    resolved: DataFrame, feed_failed: bool = False, sets_failed: bool = False
) -> DataFrame:
    """One row: importable, processed and persisted rows, and the number of errors.

    The errors themselves are a table, :func:`import_errors`; their number has no bound and is
    always that of its rows.
    """
    own = F.coalesce(F.sum(F.size(_errors())), F.lit(0)).cast("long")
    return resolved.agg(
        F.count("*").alias("total"),
        F.count("*").alias("processed"),
        F.count_if(~is_blank("card")).alias("persisted"),
        F.count_if(F.col("reason").isNotNull()).alias("unresolved"),
        (own + len(job_errors(feed_failed, sets_failed))).alias("errors"),
    )


def persist_import(resolved: DataFrame) -> DataFrame:
    """Rows to store, without id: named cards only, quantity at least 1, blanks as null."""
    return resolved.filter(~is_blank("card")).select(
        blank_to_null("card_number").alias("card_number"),
        F.col("card").alias("card_name"),
        "set_code",
        F.col("set_text").alias("set_name_raw"),
        "foil",
        "card_type",
        blank_to_null("language").alias("language"),
        F.greatest("quantity", F.lit(1)).alias("quantity"),
        "price",
        "comment",
        "location",
        "sheet",
        "row_no",
    )


def insert_import(holdings: DataFrame, rows: DataFrame, stored: bool = False) -> DataFrame:
    """Holdings plus the rows to store, numbered in grid order after the highest id in use.

    ``stored`` tells that the rows come from a settled table by no more than a filter.
    """
    numbered = number_by(rows, ["sheet", "row_no"], "_no", stored)
    added = numbered.withColumn("id", next_id(holdings) + F.col("_no"))
    return holdings.select(HOLDINGS.names).unionByName(added.select(HOLDINGS.names))


def enriched_grid(
    grid: DataFrame, resolved: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """The grid with type and price replaced where they were resolved.

    Resolved rows carry their whole grid row, so they are put back beside the rows the import
    passed over; the grid is not joined to them.
    """
    names = matching_names(grid) if names is None else names
    flagged = flag_members(grid, names, "sheet", "_imported", spread="row_no")
    imported = F.col("_imported") & _is_data_row()
    passed_over = flagged.filter(~imported).select(GRID.names)

    automatic = ~F.col("manual")
    new_type = F.when(automatic, F.col("card_type"))
    new_price = F.when(automatic, F.col("price"))
    cells = {
        "a": F.col("number_text"),
        "b": F.col("card"),
        "c": F.col("set_text"),
        "d": F.col("foil_text"),
        "e": F.coalesce(new_type, F.col("type_text")),
        "f": F.col("quantity_text"),
        "g": F.coalesce(new_price.cast("string"), F.col("price_text")),
        "h": F.col("total_text"),
        "i": F.col("comment"),
        "j": F.col("language"),
        "k": F.col("location"),
        "a_num": F.col("number_num"),
        "f_num": F.col("quantity_num"),
        "g_num": F.coalesce(new_price.cast("double"), F.col("price_num")),
    }
    filled = resolved.select("sheet", "row_no", *[c.alias(name) for name, c in cells.items()])
    return passed_over.unionByName(filled)


class ImportResult(NamedTuple):
    resolved: DataFrame
    stored: DataFrame
    grid: DataFrame
    unresolved: DataFrame
    errors: DataFrame
    metrics: DataFrame


def import_grid(
    grid: DataFrame,
    sets: DataFrame,
    feed: DataFrame | None,
    sets_feed: DataFrame | None = None,
) -> ImportResult:
    """Run the import; the resolved rows are settled once and every output derives from them.

    An empty set table is first filled from ``sets_feed``; without one, that sync has failed.
    """
    sets_failed = False
    if sets.isEmpty():
        sets_failed = sets_feed is None
        sets = sets if sets_failed else project_sets(sets_feed)
    names = settle(matching_names(grid))
    resolved = settle(resolve_grid(grid, sets, feed, names))
    return ImportResult(
        resolved,
        persist_import(resolved),
        enriched_grid(grid, resolved, names),
        unresolved_report(resolved),
        import_errors(resolved, feed is None, sets_failed),
        import_metrics(resolved, feed is None, sets_failed),
    )
