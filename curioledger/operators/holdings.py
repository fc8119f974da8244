"""Holdings: add, patch, price refresh and the plain lookups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cards import name_key, row_key
from ..functions.parsing import pick_price
from ..functions.text import cell_trim, is_blank
from ..plans.joins import lookup_join
from ..plans.lineage import settle_by_parts
from ..schemas import HOLDINGS
from .keyed import missing_keys, next_id
from .lookups import match_feed

COLUMNS = HOLDINGS.names

CARD_NOT_FOUND = "card_not_found"
ROW_NOT_FOUND = "row_not_found"
INSUFFICIENT = "insufficient_data"


def holdings_by_set(holdings: DataFrame, set_code: str | None = None) -> DataFrame:
    """Rows of one set, compared exactly; all rows without an argument."""
    return holdings if set_code is None else holdings.filter(F.col("set_code") == set_code)


def find_stack(
    holdings: DataFrame, set_code: str, card_number: str, foil: bool, language: str
) -> DataFrame:
    """Rows of one stack: same set, number, foil and language."""
    return holdings.filter(
        (F.col("set_code") == set_code)
        & (F.col("card_number") == card_number)
        & (F.col("foil") == foil)
        & (F.col("language") == language)
    )


def with_set_name(holdings: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``set_name`` by code, the code itself where it is unknown."""
    names = sets.select("set_code", F.col("set_name").alias("_name"))
    named = lookup_join(holdings, names, "set_code", "set_code")
    return named.withColumn("set_name", F.coalesce("_name", "set_code")).drop("_name")


def _split(requests: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    marked = requests.withColumn("reason", reason)
    return (
        marked.filter(F.col("reason").isNull()).drop("reason"),
        marked.filter(F.col("reason").isNotNull()),
    )


def _quantity_wrong():
    return F.coalesce("quantity", F.lit(0)) <= 0


def validate_add(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that may be added, and the others with the first rule they break."""
    return _split(
        requests,
        F.when(is_blank("card_name"), "card_name_blank")
        .when(is_blank("set_code"), "set_code_blank")
        .when(is_blank("language"), "language_blank")
        .when(_quantity_wrong(), "quantity_not_positive"),
    )


def _patch_fault():
    blank = F.when(is_blank("language"), "language_blank")
    return blank.when(_quantity_wrong(), "quantity_not_positive")


def validate_patch(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches that may be applied, and the others with the first rule they break."""
    return _split(requests, _patch_fault())


def add_holding(
    holdings: DataFrame, requests: DataFrame, feed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Insert requests whose card is in the feed; no price is set and stacks are never merged.

    ``req_seq`` (1, 2, ...) is the place of a request; ids follow the highest id in use in that
    order, a failed request leaving a gap as a database identity does.
    """
    valid, rejected = validate_add(requests)
    keyed = valid.withColumn("_key", name_key("set_code", "card_name"))
    matched = match_feed(keyed, "_key", feed, asked_only=True)
    hit = F.col("feed_hit")
    added = matched.filter(hit).select(
        (next_id(holdings) + F.col("req_seq")).alias("id"),
        F.col("feed_number").alias("card_number"),
        F.coalesce("feed_name", "card_name").alias("card_name"),
        F.coalesce("feed_set", "set_code").alias("set_code"),
        "foil",
        F.col("feed_type").alias("card_type"),
        "language",
        "quantity",
    )
    absent = matched.filter(~hit).select(
        *requests.columns, F.lit(CARD_NOT_FOUND).alias("reason")
    )
    grown = holdings.select(COLUMNS).unionByName(added, allowMissingColumns=True)
    return grown, rejected.unionByName(absent)


def _last(value, when):
    """Value of the last patch for which ``when`` holds; null when there is none."""
    return F.max_by(value, F.when(when, F.col("req_seq")))


def patch_holdings(
    holdings: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Apply patches in ``req_seq`` order; patches of one row fold into one before the join.

    Name and set: blank keeps. Foil, language, quantity: always replaced. Type, comment and
    location: null keeps, blank clears. Price: null keeps.

    Patches are combined per task before they are shuffled, and the holdings meet them where the
    folded ones lie: one shuffle by id for each side. Requests turned away are told by one look at
    the ids that are held, whatever turned them away.
    """
    valid, _ = validate_patch(requests)
    folds = [
        *[_last(F.col(c), ~is_blank(c)).alias(f"_{c}") for c in ("card_name", "set_code")],
        F.max_by(F.struct("foil", "language", "quantity"), "req_seq").alias("_given"),
        *[
            _last(cell_trim(c), F.col(c).isNotNull()).alias(f"_{c}")
            for c in ("card_type", "comment", "location")
        ],
        _last(F.col("price"), F.col("price").isNotNull()).alias("_price"),
    ]
    patches = valid.groupBy("id").agg(*folds)
    joined = lookup_join(holdings, patches, "id", "id", unique=True)
    changed = {c: F.coalesce(f"_{c}", c) for c in ("card_name", "set_code", "price")}
    changed |= {
        c: F.when(F.col("_given").isNotNull(), F.col(f"_given.{c}")).otherwise(F.col(c))
        for c in ("foil", "language", "quantity")
    }
    changed |= {
        c: F.when(F.col(f"_{c}") == "", F.lit(None)).otherwise(F.coalesce(f"_{c}", c))
        for c in ("card_type", "comment", "location")
    }
    held = holdings.select(F.col("id").alias("_held"), F.lit(True).alias("_hit"))
    known = lookup_join(requests, held, "id", "_held")
    unknown = F.when(F.col("_hit").isNull(), ROW_NOT_FOUND)
    told = known.withColumn("reason", F.coalesce(_patch_fault(), unknown)).drop("_hit")
    return joined.withColumns(changed).select(COLUMNS), told.filter(F.col("reason").isNotNull())


def refresh_status(
    holdings: DataFrame, feed: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """Holdings with type, price and blank numbers refreshed, plus the outcome per row.

    ``status`` is null for rows not asked for, else 'ok' or why the row was left as it is.
    """
    if ids is None:
        asked = holdings.withColumn("_asked", F.lit(True))
    else:
        wanted = ids.select("id").distinct().withColumn("_asked", F.lit(True))
        asked = lookup_join(holdings, wanted, "id", "id", unique=True)
    key = F.when(F.col("_asked"), row_key("set_code", "card_number", "card_name"))
    matched = match_feed(asked.withColumn("_key", key), "_key", feed, asked_only=ids is not None)
    hit = F.col("feed_hit")
    price = pick_price("foil", "feed_usd", "feed_usd_foil")
    status = (
        F.when(F.col("_asked").isNull(), F.lit(None))
        .when(F.col("_key").isNull(), INSUFFICIENT)
        .when(~hit, CARD_NOT_FOUND)
        .otherwise("ok")
    )
    return matched.withColumns(
        {
            "status": status,
            "card_type": F.when(hit, F.coalesce("feed_type", "card_type")).otherwise(
                F.col("card_type")
            ),
            "price": F.when(hit, F.coalesce(price, "price")).otherwise(F.col("price")),
            "card_number": F.when(
                hit & is_blank("card_number"), F.coalesce("feed_number", "card_number")
            ).otherwise(F.col("card_number")),
        }
    ).select(*COLUMNS, "status")


def refresh_prices(
    holdings: DataFrame, feed: DataFrame, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Holdings after the refresh, and the ids that failed with the reason."""
    return _told(holdings, refresh_status(holdings, feed, ids), ids)


def refresh_prices_by_parts(
    holdings: DataFrame, feed: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """What :func:`refresh_prices` returns, for settled holdings and asked ids of any size.

    Every row is refreshed once and settled, and both results are read from there. Holdings and ids
    are taken in parts by id, so that the shuffles of one part alone lie on disk.
    """
    refreshed = settle_by_parts(
        holdings, "id", lambda mine: refresh_status(mine(holdings), feed, mine(ids))
    )
    return _told(holdings, refreshed, ids)


def _told(
    holdings: DataFrame, refreshed: DataFrame, ids: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    failed = refreshed.filter(F.col("status") != "ok").select(
        "id", F.col("status").alias("reason")
    )
    if ids is not None:
        unknown = missing_keys(holdings, ids, "id")
        failed = failed.unionByName(unknown.withColumn("reason", F.lit(ROW_NOT_FOUND)))
    return refreshed.drop("status"), failed
