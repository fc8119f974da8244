from decimal import Decimal

import pytest
from conftest import column, rows_of
from pyspark.sql import functions as F

from curioledger.operators import imports as I
from curioledger.operators import lookups
from curioledger.sources import feeds, reports

COAST = {"set_code": "hrb", "set_name": "Harbour Lights"}
WOOD = {"set_code": "grv", "set_name": "Hollow Grove"}
GULL = {
    "name": "Grey Gull", "set": "hrb", "collector_number": "12", "type_line": "Bird",
    "usd": "0.75", "usd_foil": "2.25",
}
MOTH = {
    "name": "Day Moth // Night Moth", "set": "grv", "collector_number": "8", "type_line": "Insect",
    "usd": "11.00",
}
TITLES = ("Number (Optional)", "Card", "Set", "Foil")


def sheet(name, *rows, titles=TITLES):
    """A title line, a heading line and the rows, as a spreadsheet has them."""
    top = {"sheet": name, "row_no": 1, "b": "what I own"}
    head = {"sheet": name, "row_no": 3} | dict(zip("abcd", titles))
    return [top, head, *({"sheet": name, "row_no": k} | row for k, row in enumerate(rows, 4))]


def run(make, *rows, cards=(GULL, MOTH), sets=(COAST, WOOD)):
    return I.import_grid(make.grid(*sheet("S", *rows)), make.sets(*sets), make.feed(*cards))


def outcome(result, *names):
    return rows_of(result.resolved.orderBy("row_no"), *names)


@pytest.mark.parametrize(
    "cells, expected",
    [
        # By name, in whatever case, plain and foil.
        ({"b": "GREY gull", "c": "harbour lights "}, ("hrb", "Bird", "0.75", "12", None)),
        ({"b": "Grey Gull", "c": "Harbour Lights", "d": " YES"}, ("hrb", "Bird", "2.25", "12", None)),
        # Either face answers, and so does the whole name.
        ({"b": "night moth", "c": "Hollow Grove"}, ("grv", "Insect", "11.00", "8", None)),
        ({"b": "Day Moth // Night Moth", "c": "Hollow Grove"}, ("grv", "Insect", "11.00", "8", None)),
        # The feed has no foil price.
        ({"b": "Day Moth", "c": "Hollow Grove", "d": "s"}, ("grv", "Insect", None, "8", None)),
        # A number is the only key tried where there is one.
        ({"a": "12", "b": "any", "c": "Harbour Lights"}, ("hrb", "Bird", "0.75", "12", None)),
        ({"a": "13", "b": "Grey Gull", "c": "Harbour Lights"},
         ("hrb", None, None, "13", I.CARD_NOT_FOUND)),
        ({"b": "Grey Gull", "c": "Nowhere"}, (None, None, None, None, I.SET_NOT_FOUND)),
        ({"a": "  ", "b": "", "c": "Hollow Grove"}, ("grv", None, None, "  ", I.NO_NAME_OR_NUMBER)),
    ],
)
def test_one_row(make, cells, expected):
    result = run(make, cells)
    row = result.resolved.first()
    price = None if row.price is None else str(row.price)
    assert (row.set_code, row.card_type, price, row.card_number, row.reason) == expected


@pytest.mark.parametrize(
    "text, number, quantity",
    [("2.5", 2.5, 2), ("2.5", None, 1), ("4.0", 4.0, 4), ("4.0", None, 1), ("7", None, 7),
     ("-2", -2.0, 1), (None, None, 1), ("0.9", 0.9, 1), ("9e9", 9e9, 1)],
)
def test_quantities_of_numbers_and_texts(make, text, number, quantity):
    result = run(make, {"b": "Grey Gull", "c": "Harbour Lights", "f": text, "f_num": number})
    assert outcome(result, "quantity") == [(quantity,)]


def test_numeric_cells_name_a_card_and_a_price(make):
    by_hand = {"i": "*conferir sempre manualmente", "g": "3,5", "g_num": 3.5}
    result = run(
        make,
        {"a": "12.0", "a_num": 12.0, "c": "Harbour Lights"},
        {"a": "12.5", "a_num": 12.5, "c": "Harbour Lights"},
        {"b": "own", "c": "Nowhere"} | by_hand,
    )
    assert outcome(result, "number", "reason", "price") == [
        ("12", None, Decimal("0.75")), ("12.5", I.CARD_NOT_FOUND, None), (None, None, Decimal("3.50"))
    ]
    cells = {r.row_no: r for r in result.grid.collect()}
    assert (cells[4].a, cells[4].a_num, cells[4].g, cells[4].g_num) == ("12.0", 12.0, "0.75", 0.75)
    assert (cells[6].g, cells[6].g_num) == ("3,5", 3.5)


def test_rows_priced_by_hand(make):
    marked = {"i": "*Conferir sempre manualmente: signed", "e": "Signed", "g": "40"}
    result = run(make, {"b": "Grey Gull", "c": "Harbour Lights"} | marked, {"b": "x"} | marked)
    assert outcome(result, "card_type", "price", "reason") == [("Signed", Decimal("40.00"), None)] * 2
    assert result.resolved.filter("match_key is not null").isEmpty()


def test_cells_change_only_where_a_card_answered(make):
    before = {"e": "?", "g": "9.99", "h": "total", "k": "attic"}
    result = run(
        make,
        {"b": "Grey Gull", "c": "Harbour Lights"} | before,
        {"b": "Grey Goose", "c": "Harbour Lights"} | before,
        before,
    )
    cells = [(r.e, r.g, r.h, r.k) for r in result.grid.orderBy("row_no").collect()][2:]
    assert cells == [
        ("Bird", "0.75", "total", "attic"), ("?", "9.99", "total", "attic"),
        ("?", "9.99", "total", "attic"),
    ]


def test_errors_and_metrics_agree(make):
    rows = [
        {"b": "Grey Gull", "c": "Harbour Lights"}, {"b": "Grey Gull", "c": "Atlantis"},
        {"b": " ", "c": "Hollow Grove"}, {"a": "8", "c": "Hollow Grove"}, {"k": "no card, no set"},
    ]
    grid, sets, feed = make.grid(*sheet("S", *rows)), make.sets(COAST, WOOD), make.feed(GULL, MOTH)
    own = [
        ("S!5", I.SET_NOT_FOUND), ("S!6", I.CARD_NAME_BLANK), ("S!6", I.NO_NAME_OR_NUMBER),
        ("S!7", I.CARD_NAME_BLANK),
    ]
    for cards, stored, whole in (
        (feed, sets, []),
        (None, sets, [(None, I.LOOKUP_FAILED)]),
        (None, make.sets(), [(None, I.LOOKUP_FAILED), (None, I.SET_SYNC_FAILED)]),
    ):
        result = I.import_grid(grid, stored, cards)
        errors = rows_of(result.errors, "row_ref", "error")
        if stored is sets:
            assert sorted(errors, key=str) == sorted(own + whole, key=str)
        assert [e for e in sorted(errors, key=str) if e[0] is None] == whole
        metrics = result.metrics.first()
        assert metrics.errors == len(errors) and (metrics.total, metrics.processed) == (4, 4)
        assert metrics.persisted == 2
    assert rows_of(I.import_grid(grid, sets, feed).unresolved, "row_no", "number", "card", "set") == [
        (5, "", "Grey Gull", "Atlantis"), (6, "", " ", "Hollow Grove")
    ]


def test_stored_rows_and_their_ids(make):
    result = run(
        make,
        {"b": "Grey Gull", "c": "Harbour Lights", "f": "0", "j": " ", "k": "tin"},
        {"b": " ", "c": "Harbour Lights", "a": "12"},
        *[{"b": f"unknown {k}", "c": "Harbour Lights", "f": str(k)} for k in range(2, 6)],
    )
    names = ("card_number", "set_name_raw", "quantity", "language", "location", "price")
    assert rows_of(result.stored.filter("price is not null"), *names) == [
        ("12", "Harbour Lights", 1, None, "tin", Decimal("0.75"))
    ]
    grown = I.insert_import(make.holdings({"id": 7, "card_name": "older"}), result.stored)
    assert sorted(rows_of(grown, "id", "card_name"))[:3] == [
        (7, "older"), (8, "Grey Gull"), (9, "unknown 2")
    ]
    assert grown.count() == 6


def test_only_sheets_with_the_headings_are_read(make):
    row = {"b": "Grey Gull", "c": "Harbour Lights"}
    loose = sheet("loose", row, titles=("NUMBER (optional) ", " card", "Set", "FOIL"))
    other = sheet("other", row, titles=("Number", "Card", "Set", "Foil"))
    grid = make.grid(*loose, *other)
    assert {r.sheet for r in I.matching_sheets(grid).collect()} == {"loose"}
    result = I.import_grid(grid, make.sets(COAST), make.feed(GULL))
    assert result.metrics.first().total == 1 and result.grid.count() == 6


def test_ties_of_sets_and_cards(make):
    sets = [{"set_code": code, "set_name": name} for code, name in (("q1", "Twin"), ("q7", " twin"))]
    cards = [
        {"name": "Ant", "set": code, "collector_number": number, "usd": usd}
        for code, number, usd in ((None, "1", "5"), ("Q7", "3", "6"), ("q7", "2", "7"))
    ]
    result = run(make, {"b": "ant", "c": "TWIN"}, cards=cards, sets=sets)
    assert outcome(result, "set_code", "price", "card_number") == [("q7", Decimal("6.00"), "3")]


def test_an_empty_set_table_is_filled_from_the_feed(make, spark):
    feed = spark.createDataFrame([("hrb", "Harbour Lights", 0)], "code string, name string, feed_seq long")
    rest = {"released_at": "string", "set_type": "string", "card_count": "int", "printed_size": "int"}
    rest |= {"block_code": "string", "block": "string", "icon_svg_uri": "string"}
    feed = feed.withColumns({name: F.lit(None).cast(kind) for name, kind in rest.items()})
    grid = make.grid(*sheet("S", {"b": "Grey Gull", "c": "Harbour Lights"}))
    result = I.import_grid(grid, make.sets(), make.feed(GULL), feed)
    assert column(result.resolved, "set_code") == ["hrb"]
    assert result.errors.isEmpty()


def test_batches_of_identifiers(make):
    rows = [{"a": "12", "b": "x", "c": "Harbour Lights"}]
    rows += [{"b": f"moth {k}", "c": "Hollow Grove"} for k in range(90)]
    grid = make.grid(*sheet("S", *rows))
    named = I.normalize_grid(I.data_rows(I.matching_sheets(grid)))
    asked = I.lookup_identifiers(I.build_match_keys(I.resolve_set(named, make.sets(COAST, WOOD))))
    batches = lookups.plan_lookup_batches(asked, [asked.sheet, asked.row_no]).orderBy("batch_id")
    first, second = batches.collect()
    assert (first.identifiers, second.identifiers) == (75, 16)
    assert first.body.startswith('{"identifiers":[{"set":"hrb","collector_number":"12"},{"name":"moth 0"')
    assert second.body.endswith('{"name":"moth 89","set":"grv"}]}') and "null" not in first.body


def test_the_report_reads_back_as_spreadsheets_read_it(make, spark, folder):
    whole = run(make, {"b": "Grey Gull", "c": "Harbour Lights"})
    assert reports.write_unresolved(whole.unresolved, f"{folder}/none") is False
    odd = ' 8" moth, "rare"\nsecond line'
    some = run(make, {"b": odd, "c": "Atlantis"})
    assert reports.write_unresolved(some.unresolved, f"{folder}/some") is True
    written = spark.read.csv(f"{folder}/some", header=True, escape='"', multiLine=True)
    assert written.columns == reports.UNRESOLVED_HEADINGS
    assert column(written, "Card") == [odd]


def test_files_of_a_report_are_bounded_and_in_order(spark, folder, monkeypatch):
    monkeypatch.setattr(reports, "FILE_ROWS", 40)
    line = [F.lit("S").alias("sheet"), F.col("id").alias("row_no"), *[F.lit("two\nlines").alias(c) for c in "abcd"]]
    report = spark.range(1, 1001).select(*line, F.lit("card_not_found").alias("reason"))
    assert reports.write_unresolved(report, f"{folder}/long") is True
    written = spark.read.csv(f"{folder}/long", header=True, escape='"', multiLine=True)
    placed = written.select(F.col("_metadata.file_name").alias("file"), F.col("Linha").cast("int").alias("no"))
    files = placed.groupBy("file").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count("*").alias("rows")).orderBy("file").collect()
    assert max(f["rows"] for f in files) <= 40 and sum(f["rows"] for f in files) == 1000
    assert all(a["last"] < b["first"] for a, b in zip(files, files[1:]))


@pytest.mark.parametrize(
    "name, expected",
    [("cards.ods", "cards-processado"), ("v1.2.csv", "v1.2-processado"), ("bare", "bare-processado"),
     (".dot", ".dot-processado"), (None, "colecao-importada"), ("\t", "colecao-importada")],
)
def test_processed_name(name, expected):
    assert reports.processed_name(name) == expected


def test_the_grid_can_be_written_and_read(make, spark, folder):
    result = run(make, {"b": "Grey Gull", "c": "Harbour Lights"})
    path = reports.write_enriched_grid(result.grid, folder, "own.csv", fmt="csv")
    assert path == f"{folder}/own-processado"
    assert feeds.read_grid(spark, path, "csv").count() == 3
