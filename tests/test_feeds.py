import json
from pathlib import Path

from conftest import column, rows_of

from curioledger.operators.catalog import project_sets, upsert_sets
from curioledger.operators.lookups import expand_feed_keys
from curioledger.sources import feeds, tables


def put(folder, name, *lines):
    """Documents, or raw text as it is, one per line."""
    path = Path(folder) / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


HARBOUR = {
    "code": "hrb", "name": "Harbour Lights", "released_at": "2031-07-04", "card_count": 88,
    "printed_size": 80, "block": "Coasts", "painter": "nobody knows",
}
GROVE = {"code": "grv", "name": "Hollow Grove"}


def test_set_documents_over_several_lines(spark, folder):
    envelope = {"object": "list", "has_more": False, "pages": 3, "data": [HARBOUR, GROVE]}
    put(folder, "a.json", json.dumps(envelope, indent=1))
    put(folder, "b.json", '{"data": [{"code": "cut off')
    rows, broken = feeds.read_sets_feed(spark, folder)
    found = rows_of(rows, "code", "card_count", "printed_size", "block")
    assert found == [("hrb", 88, 80, "Coasts"), ("grv", None, None, None)]
    assert project_sets(rows).count() == 2
    assert [r.file.rpartition("/")[2] for r in broken.collect()] == ["b.json"]
    assert column(broken, "text") == ['{"data": [{"code": "cut off']


def test_envelopes_may_be_empty(spark, folder):
    for name, more in (("a", {}), ("b", {"data": None}), ("c", {"data": []})):
        put(folder, f"{name}.json", {"object": "list"} | more)
    rows, broken = feeds.read_sets_feed(spark, folder)
    assert rows.isEmpty() and broken.isEmpty()


def test_broken_lines_come_back_and_no_card_is_made_of_them(spark, folder):
    cards = [{"name": f"Moth {k}", "set": "grv", "collector_number": str(k)} for k in range(3)]
    put(folder, "c.json", cards[0], '{"name": "Moth', cards[1], "no json at all", cards[2])
    found, broken = feeds.read_card_feed(spark, folder)
    assert column(found.orderBy("feed_seq"), "name") == ["Moth 0", "Moth 1", "Moth 2"]
    assert sorted(column(broken, "text")) == ["no json at all", '{"name": "Moth']
    assert broken.count() == 2


def test_feed_order_decides_first_and_last(spark, folder, make):
    cards = [
        {"name": "Ember", "set": "hrb", "collector_number": f"{k}", "prices": {"usd": f"{k}.5"}}
        for k in range(150)
    ]
    put(folder, "cards.json", *cards)
    feed, _ = feeds.read_card_feed(spark, folder)
    by_name = expand_feed_keys(feed).filter("match_key.value = 'ember'").first()
    assert (by_name.feed_number, by_name.feed_usd) == ("0", "0.5")

    sets = Path(folder) / "sets"
    sets.mkdir()
    put(sets, "s.json", {"data": [{"code": "hrb", "name": f"try {k}"} for k in range(40)]})
    merged = upsert_sets(make.sets(), feeds.read_sets_feed(spark, str(sets))[0])
    assert column(merged, "set_name") == ["try 39"]


def test_replies_keep_their_order_and_lose_nothing(spark, folder):
    put(
        folder, "replies.json",
        {"data": [{"name": "Kite", "set": "hrb"}, None, {"name": "Gull", "set": "hrb"}],
         "not_found": [{"set": "xyz", "collector_number": "7"}]},
        '{"data": [{"name": "Lost", "set": "hrb"}, {"name":',
        {"not_found": [{"name": "Nobody", "set": "grv"}]},
    )
    cards, missing, broken = feeds.read_batch_replies(spark, folder)
    assert column(cards.orderBy("feed_seq"), "name") == ["Kite", "Gull"]
    asked = rows_of(missing.orderBy("feed_seq"), "name", "set", "collector_number")
    assert asked == [(None, "xyz", "7"), ("Nobody", "grv", None)]
    assert "Lost" in column(broken, "text")[0]


def test_tables_round_trip(spark, folder, make):
    sets = make.sets({"set_code": "grv", "set_name": "Hollow Grove", "card_count": 5})
    tables.write_table(sets, folder, "catalog_sets")
    assert tables.scan_table(spark, folder, "catalog_sets").collect() == sets.collect()


def test_grid_from_csv(spark, folder):
    put(folder, "grid.csv", "S,3,Number (Optional),Card,Set,Foil,,,,,,,", "S,4,,Kite")
    grid = feeds.read_grid(spark, folder, "csv", mode="PERMISSIVE")
    assert rows_of(grid, "sheet", "row_no", "b", "c") == [
        ("S", 3, "Card", "Set"), ("S", 4, "Kite", None)
    ]


def test_landing_parses_a_feed_once(spark, folder):
    cards = [{"name": f"Moth {k}", "set": "grv", "collector_number": str(k)} for k in range(40)]
    path = put(folder, "c.json", *cards[:20], '{"name": "Moth', *cards[20:], "no json at all")
    landed = feeds.land_card_feed(spark, path, f"{folder}/landed")
    found, broken = feeds.read_card_feed(spark, path)
    assert (landed.record_count, landed.broken_count) == (40, 2)
    assert column(landed.records.orderBy("feed_seq"), "name") == column(found.orderBy("feed_seq"), "name")
    assert sorted(column(landed.broken, "text")) == sorted(column(broken, "text"))
    assert landed.records.columns == found.columns
    # What is read later is the stored parts, not the feed.
    for part, wanted in ((landed.records, "false"), (landed.broken, "true")):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "json" not in plan.lower().replace("feeds", "") and "PartitionFilters" in plan
    clean = feeds.land_card_feed(spark, put(folder, "d.json", *cards[:3]), f"{folder}/clean")
    assert (clean.record_count, clean.broken_count, clean.broken.count()) == (3, 0, 0)


def test_landing_sets_and_replies(spark, folder):
    sets = put(folder, "s.json", {"data": [HARBOUR, GROVE]}, {"object": "list"}, '{"data": [')
    landed = feeds.land_sets_feed(spark, sets, f"{folder}/sets", multi_line=False)
    assert sorted(column(landed.records, "code")) == ["grv", "hrb"]
    assert (landed.record_count, landed.broken_count) == (2, 1)
    reply = {"data": [{"name": "Moth", "set": "grv"}], "not_found": [{"name": "Auk", "set": "grv"}]}
    cards, missing = feeds.land_batch_replies(spark, put(folder, "r.json", reply, reply), f"{folder}/replies")
    assert column(cards.records, "name") == ["Moth", "Moth"] and column(missing, "name") == ["Auk", "Auk"]
