"""Point-in-time copies of the holdings and what is asked over them."""

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import moment, ts_bound, ts_literal
from ..plans.joins import lookup_join
from ..plans.lineage import settle
from ..plans.ordering import head, number_by, number_head, number_sorted
from ..schemas import HOLDING_SNAPSHOTS
from .keyed import next_id

COLUMNS = HOLDING_SNAPSHOTS.names

IDENTITY = ["card_name", "set_code", "card_number", "foil", "language"]

# The identity as one text, for tables that are bucketed by it.
IDENTITY_KEY = "identity"

DEFAULT_LIMIT = 100

# How the export shows the foil flag.
FOIL_LABEL = {True: "Sim", False: "Não"}


def range_filter(df: DataFrame, column: str = "snapshot_ts", from_=None, to=None) -> DataFrame:
    """Inclusive range; an absent or blank bound is open, a malformed one an error."""
    low, high = ts_bound(from_), ts_bound(to, upper=True)
    if low is not None:
        df = df.filter(F.col(column) >= low)
    if high is not None:
        df = df.filter(F.col(column) <= high)
    return df


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Distinct timestamps, newest first."""
    return snapshots.select("snapshot_ts").distinct().orderBy(F.desc("snapshot_ts"))


def count_snapshot_rows(snapshots: DataFrame, ts) -> DataFrame:
    return _at(snapshots, ts).agg(F.count("*").alias("rows"))


def count_by_source(snapshots: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows per asked ``source_card_id`` over all snapshots, 0 when there is none."""
    key = "source_card_id"
    asked = ids.select(key).distinct()
    counted = (
        lookup_join(snapshots.select(key), asked, key, key, "left_semi")
        .groupBy(F.col("source_card_id").alias("_id"))
        .agg(F.count("*").alias("_rows"))
    )
    joined = asked.join(counted, F.col("source_card_id") == F.col("_id"), "left")
    return joined.select("source_card_id", F.coalesce("_rows", F.lit(0)).alias("rows"))


def _at(snapshots: DataFrame, ts) -> DataFrame:
    return snapshots.filter(F.col("snapshot_ts") == ts_literal(ts))


def snapshot_rows(snapshots: DataFrame, ts, place: str | None = None) -> DataFrame:
    """Rows of exactly one snapshot by card name; empty when it does not exist.

    ``place`` names a column for a row's place in that order, 1 first; the rows then come in no order.
    It is for a stored table, which is read and sorted range by range.
    """
    rows, order = _at(snapshots, ts), ["card_name", "id"]
    return rows.orderBy(*order) if place is None else number_by(rows, order, place, stored=True)


def snapshot_projection(rows: DataFrame, *more: str) -> DataFrame:
    """The columns shown to a reader, and ``more`` ones; ``id`` is the snapshot row's own."""
    return rows.select(
        "id",
        "source_card_id",
        "snapshot_ts",
        "card_number",
        "card_name",
        "set_code",
        "foil",
        "card_type",
        "language",
        "quantity",
        "price",
        "comment",
        "location",
        *more,
    )


def next_snapshot_ts(snapshots: DataFrame, now) -> datetime:
    """The first free second from ``now`` on.

    It is ``now`` itself or the second after a taken one. Every snapshot marks its own second as
    taken and the next as wanted; the earliest second that is wanted and not taken is the answer.
    """
    start = ts_literal(moment(now).replace(microsecond=0))
    second = F.col("snapshot_ts")

    def mark(at, taken):
        return F.struct(at.alias("at"), F.lit(taken).alias("taken"))

    marks = F.array(mark(second, True), mark(second + F.expr("INTERVAL 1 SECOND"), False))
    seen = snapshots.filter(second >= start).select("snapshot_ts").distinct().select(F.inline(marks))
    own = snapshots.sparkSession.range(1).select(F.inline(F.array(mark(start, False))))
    free = seen.unionByName(own).groupBy("at").agg(F.max("taken").alias("taken"))
    return free.filter(~F.col("taken")).agg(F.min("at")).first()[0]


class Snapshot(NamedTuple):
    rows: DataFrame
    ts: datetime


def numbered_holdings(holdings: DataFrame, name: str, ordered: bool = True) -> DataFrame:
    """Holdings numbered 1..n in a column, by id if ``ordered`` and as they lie otherwise."""
    return number_by(holdings, ["id"], name) if ordered else number_sorted(holdings, name)


def create_snapshot(
    holdings: DataFrame,
    snapshots: DataFrame,
    now,
    last_id: int | None = None,
    ordered: bool = True,
    numbers: str | None = None,
) -> Snapshot:
    """Rows of a new snapshot of all holdings, and the second it was given.

    Rows are numbered after the highest id in use, ``last_id`` when the caller keeps it, so a
    snapshot uses up as many ids as it has rows. Ids follow those of the holdings if ``ordered``,
    which takes a global sort; otherwise rows are numbered as they lie, by sums over the counts of
    unsorted partitions. Holdings of which several snapshots are taken are numbered once, by
    ``numbered_holdings``, and ``numbers`` names the column.
    """
    ts = next_snapshot_ts(snapshots, now)
    base = next_id(snapshots) if last_id is None else F.lit(last_id)
    numbered, no = holdings, numbers
    if no is None:
        numbered, no = numbered_holdings(holdings, "_no", ordered), "_no"
    stamped = numbered.withColumns(
        {
            "source_card_id": F.col("id"),
            "snapshot_ts": ts_literal(ts),
            "id": base + F.col(no),
        }
    )
    return Snapshot(stamped.select(COLUMNS), ts)


def delete_snapshot(snapshots: DataFrame, ts) -> tuple[DataFrame, DataFrame]:
    """The rows of all other snapshots, and one row telling whether any row was removed."""
    removed = count_snapshot_rows(snapshots, ts).select((F.col("rows") > 0).alias("removed"))
    return snapshots.filter(F.col("snapshot_ts") != ts_literal(ts)), removed


def total_value_by_snapshot(snapshots: DataFrame, from_=None, to=None) -> DataFrame:
    """Value of the holdings per snapshot, oldest first; an unpriced row counts as 0."""
    value = F.coalesce("price", F.lit(0)) * F.col("quantity")
    return (
        range_filter(snapshots, "snapshot_ts", from_, to)
        .groupBy("snapshot_ts")
        .agg(F.coalesce(F.sum(value), F.lit(0)).alias("total_value"))
        .orderBy("snapshot_ts")
    )


def series_summary(totals: DataFrame) -> DataFrame:
    """One row over a total-value series; none when the series is empty."""
    first = F.min_by("total_value", "snapshot_ts")
    last = F.max_by("total_value", "snapshot_ts")
    return totals.agg(
        F.count("*").alias("count"),
        first.alias("first"),
        last.alias("last"),
        (last - first).alias("delta"),
        F.min("total_value").alias("min"),
        F.max("total_value").alias("max"),
    ).filter(F.col("count") > 0)


def latest_two(snapshots: DataFrame, from_=None, to=None) -> DataFrame:
    """The two newest timestamps in range, oldest first; fewer when there are fewer."""
    newest = list_snapshots(range_filter(snapshots, "snapshot_ts", from_, to)).limit(2)
    return newest.orderBy("snapshot_ts")


class Movers(NamedTuple):
    """Both lists, and the seconds compared; null where there were not two snapshots to compare."""

    gainers: DataFrame
    losers: DataFrame
    old_ts: datetime | None
    new_ts: datetime | None


def compared(snapshots: DataFrame, from_=None, to=None) -> tuple[datetime, datetime] | None:
    """The two newest seconds in range; nothing where there are fewer."""
    found = [r["snapshot_ts"] for r in latest_two(snapshots, from_, to).collect()]
    return (found[0], found[1]) if len(found) == 2 else None


def identity_key() -> Column:
    """The identity columns as one text, never null; different for different identities."""
    return F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"})


def price_changes(snapshots: DataFrame, pair: tuple[datetime, datetime] | None) -> DataFrame:
    """Every row of the newest snapshot whose card had another price in the one before.

    A card is the same when all five identity columns agree, null with null. The older side is
    reduced to one row per identity before its shuffle (the highest id stands for duplicates),
    the newer side keeps every row. ``pair`` is what :func:`compared` found; without one no row
    comes out.

    A table that carries the identity as a column of its own (``bucketed_snapshots``) is grouped and
    joined by that column, and where it is bucketed by it neither side is shuffled.
    """
    old_at, new_at = [F.lit(False)] * 2
    if pair is not None:
        old_at, new_at = [F.col("snapshot_ts") == ts_literal(ts) for ts in pair]
    own = [IDENTITY_KEY] if IDENTITY_KEY in snapshots.columns else IDENTITY
    old = (
        snapshots.filter(old_at)
        .groupBy([F.col(c).alias(f"_{c}") for c in own])
        .agg(F.max_by("price", "id").alias("_price"))
    )
    new = snapshots.filter(new_at)
    same = F.lit(True)
    for c in own:
        # The identity as a text is never null, and a plain comparison keeps to its buckets.
        one, other = F.col(c), F.col(f"_{c}")
        same = (one == other) if own == [IDENTITY_KEY] else same & one.eqNullSafe(other)
    price_old = F.coalesce("_price", F.lit(0).cast("decimal(12,2)"))
    price_new = F.coalesce("price", F.lit(0).cast("decimal(12,2)"))
    diff = price_new - price_old
    return (
        new.join(old, same, "inner")
        .filter(diff != 0)
        .select(
            "id",
            "card_name",
            "set_code",
            "set_name_raw",
            "foil",
            "language",
            "source_card_id",
            price_old.alias("price_old"),
            price_new.alias("price_new"),
            diff.alias("price_diff"),
            F.when(diff > 0, "gainer").otherwise("loser").alias("side"),
        )
    )


def mover_order(side: str) -> list[Column]:
    """Total order of a list: largest change first, equal ones by name, then by snapshot row."""
    change = F.col("price_diff")
    return [change.desc() if side == "gainer" else change.asc(), F.col("card_name"), F.col("id")]


def check_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError(f"limit must be >= 0, got {limit}")
    return limit


def price_movers(
    snapshots: DataFrame, from_=None, to=None, limit: int = DEFAULT_LIMIT
) -> Movers:
    """Rows that gained and rows that lost the most, ``limit`` of each; 0 keeps all.

    The changes are computed once and both lists taken from them. Fewer than two snapshots in range
    give empty lists and no seconds; two without a change give empty lists and both seconds.
    """
    check_limit(limit)
    pair = compared(snapshots, from_, to)
    changes = settle(price_changes(snapshots, pair))
    lists = [
        head(changes.filter(F.col("side") == side), mover_order(side), limit).drop("side")
        for side in ("gainer", "loser")
    ]
    return Movers(*lists, *(pair or (None, None)))


def export_projection(movers: DataFrame, order: list[Column], limit: int = 0) -> DataFrame:
    """Numbered export rows of one mover list."""
    raw_name = F.nullif("set_name_raw", F.lit(""))
    return number_head(movers, order, limit, "row_no").select(
        "row_no",
        "card_name",
        F.coalesce(raw_name, "set_code").alias("set_name"),
        "set_code",
        F.when(F.col("foil"), FOIL_LABEL[True]).otherwise(FOIL_LABEL[False]).alias("foil"),
        F.coalesce("language", F.lit("")).alias("language"),
        "price_old",
        "price_new",
        "price_diff",
    )
