import random
from decimal import Decimal

import pytest
from conftest import column, money, rows_of, ts
from pyspark.sql import functions as F

from curioledger.operators import snapshots as S
from curioledger.sources import reports, tables

T1, T2, T3 = ts("2025-11-01T10:00:00"), ts("2025-11-02T10:00:00"), ts("2025-11-03T10:00:00")

GULL = {"card_name": "Grey Gull", "set_code": "hrb", "card_number": "12", "quantity": 3}
MOTH = {"card_name": "Day Moth", "set_code": "grv", "card_number": "8", "foil": True}


def taken(make, rows, snaps, now):
    """The stored snapshots with one more of the holdings given."""
    return snaps.unionByName(S.create_snapshot(make.holdings(*rows), snaps, now).rows)


def test_value_over_time(make):
    gull, moth = GULL | {"id": 5, "price": money("0.20")}, MOTH | {"id": 9, "price": money("7.05")}
    snaps = taken(make, [gull, moth], make.snapshots(), T1)
    snaps = taken(make, [gull | {"quantity": 10}, moth | {"price": None}], snaps, T2)
    snaps = taken(make, [moth], snaps, T3)
    totals = S.total_value_by_snapshot(snaps)
    assert rows_of(totals, "snapshot_ts", "total_value") == [
        (T1, Decimal("7.65")), (T2, Decimal("2.00")), (T3, Decimal("7.05"))
    ]
    summary = S.series_summary(totals).first()
    assert (summary["count"], summary.delta) == (3, Decimal("-0.60"))
    assert (summary["min"], summary["max"]) == (Decimal("2.00"), Decimal("7.65"))


def test_generations_are_numbered_without_gaps_or_overflow(make):
    top = 2**62
    rows = [GULL | {"id": top + 10 * k} for k in range(4)]
    snaps = make.snapshots({"id": 100, "snapshot_ts": T1})
    for _ in range(3):
        one = S.create_snapshot(make.holdings(*rows), snaps, T2)
        snaps = snaps.unionByName(one.rows)
    found = rows_of(snaps.filter("id > 100").orderBy("id"), "id", "source_card_id", "snapshot_ts")
    assert [r[0] for r in found] == list(range(101, 113))
    assert [r[1] for r in found] == [top + 10 * k for k in range(4)] * 3
    assert [r[2].second for r in found] == [0] * 4 + [1] * 4 + [2] * 4
    assert one.ts == T2.replace(second=2)


def test_only_unpriced_rows_make_a_zero_point(make):
    snaps = make.snapshots({"snapshot_ts": T1, "price": None})
    assert column(S.total_value_by_snapshot(snaps), "total_value") == [Decimal("0.00")]


def test_ranges_are_inclusive_and_open_ended(make):
    snaps = make.snapshots(*[{"snapshot_ts": t} for t in (T1, T2, T3)])

    def found(**bounds):
        return column(S.total_value_by_snapshot(snaps, **bounds), "snapshot_ts")

    assert found(from_="2025-11-02T10:00", to="2025-11-02T10:00:00") == [T2]
    assert found(from_="2025-11-02T10:00:00") == [T2, T3]
    assert found(to="2025-11-02T10:00:00") == [T1, T2]
    assert found(from_=" ", to=None) == [T1, T2, T3]
    assert found(from_="2025-11-02T10:00:00.0000001") == [T3]
    with pytest.raises(ValueError):
        found(from_="soon")


def test_a_taken_second_moves_forward(make):
    base = ts("2025-11-01T10:00:00")
    used = [base, base.replace(second=1), base.replace(second=3)]
    snaps = make.snapshots(*[{"id": i + 1, "snapshot_ts": t} for i, t in enumerate(used)])
    now = base.replace(microsecond=700_000)
    own = make.holdings(GULL | {"id": 2})
    found = S.create_snapshot(own, snaps, now)
    assert found.ts == base.replace(second=2)
    assert rows_of(found.rows, "id", "source_card_id", "snapshot_ts") == [(4, 2, found.ts)]
    free = S.create_snapshot(own, make.snapshots(), now, last_id=10)
    assert (free.ts, column(free.rows, "id")) == (base, [11])


def test_listing_and_deleting(make):
    snaps = make.snapshots(*[{"id": i, "snapshot_ts": t} for i, t in enumerate((T1, T2, T2))])
    assert column(S.list_snapshots(snaps), "snapshot_ts") == [T2, T1]
    assert S.count_snapshot_rows(snaps, T2).first().rows == 2
    kept, removed = S.delete_snapshot(snaps, T2)
    assert column(S.list_snapshots(kept), "snapshot_ts") == [T1]
    assert removed.first().removed is True
    assert S.delete_snapshot(snaps, T3)[1].first().removed is False


def test_an_empty_collection_leaves_no_snapshot(make):
    rows = S.create_snapshot(make.holdings(), make.snapshots(), T1).rows
    assert S.list_snapshots(rows).isEmpty()
    assert S.total_value_by_snapshot(rows).isEmpty()
    assert S.series_summary(S.total_value_by_snapshot(rows)).isEmpty()


def test_snapshot_rows_by_name_and_projection(make):
    snaps = make.snapshots(
        {"id": 3, "card_name": "b", "snapshot_ts": T1, "set_name_raw": "x"},
        {"id": 2, "card_name": "a", "snapshot_ts": T1},
        {"id": 1, "card_name": "b", "snapshot_ts": T1},
        {"id": 0, "card_name": "a", "snapshot_ts": T2},
    )
    rows = S.snapshot_rows(snaps, T1)
    assert column(rows, "id") == [2, 1, 3]
    shown = S.snapshot_projection(rows).columns
    assert len(shown) == 13 and "set_name_raw" not in shown


def test_count_by_source_keeps_unknown_ids(make, spark):
    snaps = make.snapshots(*[{"source_card_id": i, "snapshot_ts": T1} for i in (7, 7, 8)])
    ids = spark.createDataFrame([(7,), (9,), (7,)], "source_card_id long")
    assert sorted(rows_of(S.count_by_source(snaps, ids), "source_card_id", "rows")) == [
        (7, 2), (9, 0)
    ]


def test_latest_two_oldest_first(make):
    snaps = make.snapshots(*[{"snapshot_ts": t} for t in (T3, T1, T2, T3)])
    assert column(S.latest_two(snaps), "snapshot_ts") == [T2, T3]
    assert column(S.latest_two(snaps, to="2025-11-01T10:00:00"), "snapshot_ts") == [T1]


def mover(i, t, price, **more):
    row = {"id": i, "snapshot_ts": t, "card_name": "c", "source_card_id": i}
    return row | {"price": None if price is None else money(price)} | more


def test_movers_match_null_with_null(make):
    blank = {"set_code": None, "card_number": None, "language": None}
    snaps = make.snapshots(mover(1, T1, "1.00", **blank), mover(2, T2, "3.00", **blank))
    assert rows_of(S.price_movers(snaps).gainers, "price_diff") == [(Decimal("2.00"),)]


def test_movers_rules(make):
    snaps = make.snapshots(
        mover(1, T1, "1.00", card_name="up"), mover(2, T2, "4.00", card_name="up"),
        mover(3, T1, "9.00", card_name="down"), mover(4, T2, "2.00", card_name="down"),
        mover(5, T1, "5.00", card_name="same"), mover(6, T2, "5.00", card_name="same"),
        mover(7, T1, None, card_name="priced"), mover(8, T2, "2.00", card_name="priced"),
        mover(9, T1, "2.00", card_name="unpriced"), mover(10, T2, None, card_name="unpriced"),
        mover(11, T1, "2.00", card_name="gone"), mover(12, T2, "2.00", card_name="new"),
        mover(13, T1, "1.00", card_name="foil"), mover(14, T2, "2.00", card_name="foil", foil=True),
        mover(0, ts("2020-01-01T00:00:00"), "100.00", card_name="up"),
    )
    gainers, losers, old_ts, new_ts = S.price_movers(snaps)
    assert (old_ts, new_ts) == (T1, T2)
    assert rows_of(gainers, "card_name", "price_old", "price_new") == [
        ("up", Decimal("1.00"), Decimal("4.00")), ("priced", Decimal("0.00"), Decimal("2.00"))
    ]
    assert rows_of(losers, "card_name", "price_diff") == [
        ("down", Decimal("-7.00")), ("unpriced", Decimal("-2.00"))
    ]


def test_movers_duplicates_old_last_new_all(make):
    snaps = make.snapshots(
        mover(1, T1, "1.00"), mover(2, T1, "2.00"), mover(3, T2, "5.00"), mover(4, T2, "5.00")
    )
    found = rows_of(S.price_movers(snaps).gainers, "id", "price_old", "price_diff")
    assert found == [(3, Decimal("2.00"), Decimal("3.00")), (4, Decimal("2.00"), Decimal("3.00"))]


def test_movers_limits_and_ties(make):
    names = ["d", "a", "c", "b"]
    old = [mover(i, T1, "1.00", card_name=n) for i, n in enumerate(names)]
    new = [mover(i + 10, T2, "2.00", card_name=n) for i, n in enumerate(names)]
    snaps = make.snapshots(*old, *new)
    assert column(S.price_movers(snaps, limit=2).gainers, "card_name") == ["a", "b"]
    assert column(S.price_movers(snaps, limit=0).gainers, "card_name") == sorted(names)
    with pytest.raises(ValueError):
        S.price_movers(snaps, limit=-1)


def test_movers_need_two_snapshots_in_range(make):
    snaps = make.snapshots(mover(1, T1, "1.00"), mover(2, T2, "2.00"))
    for found in (S.price_movers(snaps, from_="2025-11-02T00:00"), S.price_movers(make.snapshots())):
        assert found.gainers.isEmpty() and found.losers.isEmpty()
        assert (found.old_ts, found.new_ts) == (None, None)
    same = S.price_movers(make.snapshots(mover(1, T1, "1.00"), mover(2, T2, "1.00")))
    assert same.gainers.isEmpty() and (same.old_ts, same.new_ts) == (T1, T2)


def changes_of(snaps):
    return S.price_changes(snaps, S.compared(snaps))


def test_movers_against_brute_force(make):
    random.seed(7)

    def pick(*values):
        return random.choice(values)

    rows = [
        {
            "id": i, "snapshot_ts": pick(T1, T2, T3), "card_name": pick("a", "b"),
            "set_code": pick("s", None), "card_number": pick("1", None), "foil": pick(True, False),
            "language": pick("en", None), "price": pick(None, money("1.00"), money("2.50")),
        }
        for i in range(300)
    ]
    key = ("card_name", "set_code", "card_number", "foil", "language")
    old = {}
    for row in rows:
        if row["snapshot_ts"] == T2:
            old[tuple(row[k] for k in key)] = row["price"] or 0
    expected = []
    for row in rows:
        before = old.get(tuple(row[k] for k in key))
        if row["snapshot_ts"] == T3 and before is not None:
            diff = (row["price"] or 0) - before
            if diff:
                expected.append((row["id"], diff))
    found = rows_of(changes_of(make.snapshots(*rows)), "id", "price_diff")
    assert sorted(found) == sorted(expected) and expected


def test_export_projection(make):
    snaps = make.snapshots(
        mover(1, T1, "1.00", card_name="x", set_code="neo"),
        mover(2, T2, "2.00", card_name="x", set_code="neo", set_name_raw=""),
        mover(3, T1, "1.00", card_name="y", foil=True, language=None),
        mover(4, T2, "5.00", card_name="y", foil=True, language=None, set_name_raw="Raw"),
    )
    changes = changes_of(snaps).filter(F.col("side") == "gainer")
    rows = S.export_projection(changes, S.mover_order("gainer"))
    shown = sorted(rows_of(rows, "row_no", "card_name", "set_name", "foil", "language"))
    assert shown == [(1, "y", "Raw", "Sim", ""), (2, "x", "neo", "Não", "en")]


def test_export_movers_writes_both_lists(make, spark, folder):
    snaps = make.snapshots(
        mover(1, T1, "1.00", card_name=" x"), mover(2, T2, "2.00", card_name=" x"),
        mover(3, T1, "3.00", card_name="y"), mover(4, T2, "2.00", card_name="y"),
    )
    reports.export_movers(changes_of(snaps), folder)
    up = spark.read.csv(f"{folder}/{reports.GAINERS_NAME}", header=True)
    down = spark.read.csv(f"{folder}/{reports.LOSERS_NAME}", header=True)
    assert up.columns == reports.MOVERS_HEADINGS
    assert (column(up, "Carta"), column(down, "Carta")) == ([" x"], ["y"])


def test_snapshot_table_is_partitioned_and_pruned(make, spark, folder):
    for t, price in ((T1, "1.00"), (T2, "2.50")):
        stored = make.snapshots(mover(1, t, price))
        tables.append_snapshot(stored, folder)
    snaps = tables.scan_table(spark, folder, "holding_snapshots")
    assert column(S.list_snapshots(snaps), "snapshot_ts") == [T2, T1]
    assert column(S.price_movers(snaps).gainers, "price_diff") == [Decimal("1.50")]
    plan = S.snapshot_rows(snaps, T1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_ts" in plan


def test_numbering_as_rows_lie(make, spark):
    held = make.holdings(*[GULL | {"id": 9 * k} for k in range(50)]).repartition(7)
    taken = S.create_snapshot(held, make.snapshots(), T1, last_id=100, ordered=False)
    rows = rows_of(taken.rows, "id", "source_card_id")
    assert sorted(k for k, _ in rows) == list(range(101, 151))
    assert sorted(s for _, s in rows) == [9 * k for k in range(50)]
    plan = taken.rows._jdf.queryExecution().executedPlan().toString()
    assert "Sort [id" not in plan and "rangepartitioning" not in plan
    assert S.create_snapshot(make.holdings(), make.snapshots(), T1, ordered=False).rows.isEmpty()


def test_an_append_run_twice_leaves_one_copy(make, spark, folder):
    stored = make.snapshots()
    for now in (T1, T2):
        held = make.holdings(*[GULL | {"id": k} for k in range(20)]).repartition(3)
        taken = S.create_snapshot(held, stored, now, ordered=False)
        tables.append_snapshot(taken.rows, folder)
        tables.append_snapshot(taken.rows, folder)
        stored = tables.scan_table(spark, folder, "holding_snapshots")
    assert stored.count() == 40
    assert sorted(column(stored, "id")) == list(range(1, 41))


def test_movers_over_buckets_need_no_shuffle(make, spark, folder):
    rows = [mover(k, T1, f"{k}.00", card_name=f"c{k % 30}", set_code=None if k % 2 else "grv") for k in range(60)]
    rows += [mover(100 + k, T2, f"{k + k % 3}.50", card_name=f"c{k % 30}", set_code=None if k % 2 else "grv") for k in range(60)]
    snaps = make.snapshots(*rows)
    table = "buckets_" + folder.rpartition("-")[2].lower()
    for at in (T1, T2, T2):
        stored = tables.append_bucketed_snapshot(snaps.filter(F.col("snapshot_ts") == F.lit(at).cast("timestamp_ntz")), folder, table, 4)
    assert stored.count() == 120
    changes = S.price_changes(stored, (T1, T2))
    names = ("id", "price_old", "price_new", "side")
    assert sorted(rows_of(changes, *names)) == sorted(rows_of(S.price_changes(snaps, (T1, T2)), *names))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.price_changes(stored, (T1, T2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert plan.count("SelectedBucketsCount: 4 out of 4") == 2
    found = [rows_of(S.price_movers(t, limit=5).gainers, "id", "price_diff") for t in (stored, snaps)]
    assert found[0] == found[1]
    # A session that knows nothing of the table finds it by its files.
    spark.sql(f"drop table {table}")
    assert tables.bucketed_snapshots(spark, folder, table, 4).count() == 120


def test_totals_are_kept_and_only_new_partitions_read(make, spark, folder, monkeypatch):
    rows = [
        {"id": k, "snapshot_ts": t, "price": p and money(p), "quantity": q}
        for k, (t, p, q) in enumerate(((T1, "1.50", 2), (T1, None, 9), (T2, "4.00", 1)))
    ]
    scanned = []

    def watched(snapshots, *bounds):
        scanned.append(sorted({r["snapshot_ts"] for r in snapshots.select("snapshot_ts").collect()}))
        plan = snapshots._jdf.queryExecution().executedPlan().toString()
        scanned.append("snapshot_ts" in plan.partition("PartitionFilters: [")[2].partition("]")[0])
        return S.total_value_by_snapshot(snapshots, *bounds)

    monkeypatch.setattr(tables, "total_value_by_snapshot", watched)
    tables.append_snapshot(make.snapshots(*rows), folder)
    stored = tables.scan_table(spark, folder, "holding_snapshots")
    first = rows_of(tables.refresh_totals(stored, folder), "snapshot_ts", "total_value")
    assert first == [(T1, Decimal("3.00")), (T2, Decimal("4.00"))] and scanned == [[T1, T2], False]
    assert rows_of(tables.refresh_totals(stored, folder), "snapshot_ts", "total_value") == first
    assert len(scanned) == 2
    tables.append_snapshot(make.snapshots({"id": 9, "snapshot_ts": T3, "price": money("2.00")}), folder)
    stored = tables.scan_table(spark, folder, "holding_snapshots")
    totals = tables.refresh_totals(stored, folder)
    assert column(totals, "total_value") == [Decimal("3.00"), Decimal("4.00"), Decimal("2.00")]
    # The second refresh after an append reads the one partition that is new.
    assert scanned[2:] == [[T3], True]
    kept, _ = S.delete_snapshot(stored, T2)
    assert column(tables.refresh_totals(kept, folder), "snapshot_ts") == [T1, T3]
    exact = rows_of(S.total_value_by_snapshot(kept), "snapshot_ts", "total_value")
    assert rows_of(tables.refresh_totals(kept, folder), "snapshot_ts", "total_value") == exact
