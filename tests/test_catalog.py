from datetime import date

import pytest
from conftest import column, rows_of

from curioledger.operators import catalog as C
from curioledger.operators import keyed
from curioledger.schemas import FEED_SET

COAST = {
    "set_code": "hrb", "set_name": "Harbour Lights", "release_date": date(2031, 7, 4),
    "set_type": "core", "card_count": 88, "printed_size": 80, "block_code": "CO",
    "block_name": "Coasts", "icon_svg_uri": "icons/hrb.svg",
}
WOOD = {"set_code": "grv", "set_name": "Hollow Grove", "icon_svg_uri": "\t"}

FORM = (
    "req_seq long, path_code string, set_code string, set_name string, release_date string,"
    " set_type string, card_count string, printed_size string, block_code string,"
    " block_name string"
)
FORM_NAMES = FORM.replace(",", "").split()[::2]


def set_feed(spark, *records):
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FEED_SET)
    rows = [(k, *[r.get(n) for n in FEED_SET.names]) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, f"feed_seq long, {columns}")


def forms(spark, *records):
    """What forms send, cleaned as the operators expect it."""
    full = [{"req_seq": k, "path_code": r["set_code"]} | r for k, r in enumerate(records)]
    sent = spark.createDataFrame([tuple(r.get(n) for n in FORM_NAMES) for r in full], FORM)
    return C.clean_set_input(sent)


@pytest.mark.parametrize(
    "text, expected",
    [("2031-07-04", date(2031, 7, 4)), ("2031-7-4", None), ("2031", None), ("04.07.2031", None),
     ("2031-02-30", None), (None, None)],
)
def test_dates_of_the_feed(spark, text, expected):
    rows = C.project_sets(set_feed(spark, {"code": "hrb", "released_at": text, "block": "Coasts"}))
    assert rows_of(rows, "set_code", "release_date", "block_name") == [("hrb", expected, "Coasts")]


def test_upsert(make, spark):
    feed = set_feed(
        spark,
        {"code": "new", "name": "one", "card_count": 3}, {"code": "hrb", "name": "once"},
        {"code": None, "name": "no code"}, {"code": "hrb", "name": "twice", "block_code": "X"},
    )
    merged = {r.set_code: r for r in C.upsert_sets(make.sets(COAST, WOOD), feed).collect()}
    assert set(merged) == {"hrb", "grv", "new"}
    changed = merged["hrb"]
    assert (changed.set_name, changed.block_code) == ("twice", "X")
    assert changed.release_date is None and changed.icon_svg_uri is None
    assert merged["grv"].icon_svg_uri == "\t" and merged["new"].card_count == 3
    assert C.upsert_sets(make.sets(COAST), set_feed(spark)).count() == 1


def test_forms_are_cleaned(spark):
    clean, incomplete = forms(
        spark,
        {"set_code": "\thrb", "set_name": "Harbour ", "set_type": " ", "card_count": " 88",
         "printed_size": "8x", "block_name": " Coasts ", "release_date": " 2031-07-04 "},
        {"set_code": "bad", "set_name": "Date", "release_date": "soon"},
        {"set_code": "", "set_name": "n"}, {"set_code": "n", "set_name": " "},
    )
    names = ("set_code", "set_name", "set_type", "card_count", "printed_size", "release_date")
    assert rows_of(clean, *names) == [
        ("hrb", "Harbour", None, 88, None, date(2031, 7, 4)), ("bad", "Date", None, None, None, None)
    ]
    assert sorted(column(incomplete, "req_seq")) == [2, 3]


def test_create_and_update(make, spark):
    sets = make.sets(COAST, WOOD)
    asked, _ = forms(
        spark,
        {"set_code": "isl", "set_name": "Islands", "release_date": "not a day"},
        {"set_code": "isl", "set_name": "Islands too"}, {"set_code": "grv", "set_name": "taken"},
    )
    grown, conflicts = C.create_set(sets, asked)
    assert dict(rows_of(grown, "set_code", "set_name")) == {
        "hrb": "Harbour Lights", "grv": "Hollow Grove", "isl": "Islands"
    }
    assert sorted(column(conflicts, "set_name")) == ["Islands too", "taken"]

    asked, _ = forms(
        spark,
        {"set_code": "hrb", "set_name": "Old Harbour", "card_count": "90"},
        {"set_code": "hrb", "set_name": "New Harbour", "block_name": "Sea"},
        {"set_code": "grv", "path_code": "GRV", "set_name": "x"}, {"set_code": "isl", "set_name": "x"},
    )
    updated, rejected = C.update_set(sets, asked)
    coast = updated.filter("set_code = 'hrb'").first()
    assert (coast.set_name, coast.block_name, coast.card_count) == ("New Harbour", "Sea", None)
    assert coast.icon_svg_uri == "icons/hrb.svg" and updated.count() == 2
    assert sorted(rows_of(rejected, "set_code", "reason")) == [
        ("grv", "code_mismatch"), ("isl", "not_found")
    ]


def test_by_code(make, spark):
    sets = make.sets(COAST, WOOD)
    codes = spark.createDataFrame([("grv",), ("isl",), ("isl",)], "set_code string")
    kept, missing = C.delete_set(sets, codes)
    assert (column(kept, "set_code"), column(missing, "set_code")) == (["hrb"], ["isl"])
    found, absent = keyed.get_by_key(sets, codes, "set_code")
    assert (column(found, "set_name"), column(absent, "set_code")) == (["Hollow Grove"], ["isl"])
    flags = rows_of(keyed.exists_key(codes, sets, "set_code"), "set_code", "exists")
    assert sorted(flags) == [("grv", True), ("isl", False), ("isl", False)]


@pytest.mark.parametrize(
    "fields, codes",
    [
        ({}, "grv hrb"), ({"set_name": " H "}, "grv hrb"), ({"set_name": "light"}, "hrb"),
        ({"set_code": "R"}, "grv hrb"), ({"set_type": "COR", "block_code": "o"}, "hrb"),
        ({"block_name": "coast", "set_name": "hollow"}, ""), ({"release_date": " 2031-07-04"}, "hrb"),
        ({"release_date": "2031"}, ""), ({"card_count": 88}, "hrb"), ({"card_count": -1}, "grv hrb"),
        ({"printed_size": 88}, ""), ({"set_code": "none", "editing": True}, "grv hrb"),
    ],
)
def test_filters(make, fields, codes):
    found = C.filter_sets(make.sets(COAST, WOOD), **fields)
    assert sorted(column(found, "set_code")) == codes.split()


@pytest.mark.parametrize("text, codes", [("HARB", "hrb"), (" rv ", "grv"), ("\t", "grv hrb"), (None, "grv hrb"), ("zz", "")])
def test_search(make, text, codes):
    assert sorted(column(C.search_sets(make.sets(COAST, WOOD), text), "set_code")) == codes.split()


def test_icons_to_fetch(make, spark):
    held = {"set_code": "isl", "icon_svg_uri": "icons/isl.svg"}
    cached = spark.createDataFrame([("isl.svg",), ("hrb",)], "object_key string")
    work = C.icon_worklist(make.sets(COAST, WOOD, held), cached)
    assert rows_of(work, "set_code", "object_key", "icon_svg_uri") == [
        ("hrb", "hrb.svg", "icons/hrb.svg")
    ]
