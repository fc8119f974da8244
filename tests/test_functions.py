from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import column
from pyspark.sql import functions as F

from curioledger.functions import cards, parsing, text


def apply(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return column(rows.coalesce(1).orderBy("i").select(expression("c").alias("r")), "r")


def test_norm_trims_controls_and_lowers(spark):
    values = ["  Urza's Destiny\t", "\x00A\n", None, "", " É "]
    assert apply(spark, text.norm, values) == ["urza's destiny", "a", "", "", "é"]


def test_blank_means_null_or_whitespace_only(spark):
    values = [None, "", " \t\n", "　", "x", " x ", " "]
    assert apply(spark, text.is_blank, values) == [True, True, True, True, False, False, False]


def test_form_trim_takes_non_breaking_spaces(spark):
    assert apply(spark, text.form_trim, ["  x﻿", " "]) == ["x", ""]


def test_natural_order_is_numeric_case_and_accent_insensitive(spark):
    expected = ["", "-1", "2", "10", "1" * 40, "a", "a2", "a10", "ab 3", "ab9x", "É1", "e2", "Z"]
    rows = spark.createDataFrame([(v,) for v in reversed(expected)], "s string")
    keyed = rows.withColumn("k", text.collation_key("s"))
    assert column(keyed.orderBy("k"), "s") == expected


def test_natural_key_ignores_leading_zeros(spark):
    one, two, zero = apply(spark, text.natural_key, ["a007", "A7", "a000"])
    assert one == two != zero


def test_safe_date_is_strict(spark):
    values = ["2022-02-18", "not-a-date", None, "", "2022", "2022-2-3", "2022-02-30", " 2022-02-18"]
    assert apply(spark, parsing.safe_date, values) == [date(2022, 2, 18)] + [None] * 7


def test_parse_ts_is_strict(spark):
    values = ["2025-11-18T10:22:31", "2025-11-18T10:22", "2025-11-18", "2025-11-18 10:22:31", "x"]
    parsed = apply(spark, parsing.parse_ts, values)
    assert parsed[:2] == [datetime(2025, 11, 18, 10, 22, 31), datetime(2025, 11, 18, 10, 22)]
    assert parsed[2:] == [None] * 3


@pytest.mark.parametrize("bad", ["2025-11-18", "yesterday", "2025-11-18T10:22:31Z"])
def test_malformed_bound_is_an_error(spark, bad):
    with pytest.raises(ValueError):
        parsing.ts_bound(bad)


def test_blank_bound_is_open(spark):
    assert parsing.ts_bound(None) is None and parsing.ts_bound("  ") is None


def test_foil_words(spark):
    values = [" Sim", "S", "YES", "y", "foil", "True", "Não", "", None, "simm"]
    assert apply(spark, parsing.foil_flag, values) == [True] * 6 + [False] * 4


def test_manual_marker(spark):
    values = ["  *CONFERIR sempre manualmente (loja)", "conferir", None]
    assert apply(spark, parsing.manual_flag, values) == [True, False, False]


def test_quantity(spark):
    values = ["3", " 4 ", "+2", "0", "-5", "2.5", "x", "", None, "99999999999"]
    assert apply(spark, parsing.parse_quantity, values) == [3, 4, 2, 1, 1, 1, 1, 1, 1, 1]


def test_cell_decimal(spark):
    values = [" 1.50 ", "1e2", "x", "", None, "1.005", "99999999999"]
    expected = [Decimal("1.50"), Decimal("100.00"), None, None, None, Decimal("1.01"), None]
    assert apply(spark, parsing.cell_decimal, values) == expected


def test_pick_price_rejects_padded_and_malformed_text(spark):
    def price(c):
        return parsing.pick_price(F.lit(False), c, F.lit("9"))

    values = ["1.23", " 1.23", "1.23 ", "n/a", "", None]
    assert apply(spark, price, values) == [Decimal("1.23")] + [None] * 5
    foil = apply(spark, lambda c: parsing.pick_price(F.lit(True), F.lit("9"), c), ["5.67"])
    assert foil == [Decimal("5.67")]


def test_split_faces(spark):
    values = ["A // B", "A", "A //   // B", " // ", None]
    assert apply(spark, cards.split_faces, values) == [["A", "B"], [], ["A", "B"], [], []]


def test_feed_keys_have_no_repeats(spark):
    def keys(c):
        return cards.feed_keys(F.lit("GRV"), F.lit("8"), c)

    number = ("number", "grv", "8")
    two, twice, nameless = apply(spark, keys, ["Day // Night", "Day // day", None])
    assert [tuple(k) for k in two] == [
        number, ("name", "grv", "day // night"), ("name", "grv", "day"), ("name", "grv", "night")
    ]
    assert [tuple(k) for k in twice] == [number, ("name", "grv", "day // day"), ("name", "grv", "day")]
    assert [tuple(k) for k in nameless] == [number]
    assert apply(spark, lambda c: cards.feed_keys(c, F.lit("1"), F.lit("x")), [None]) == [None]


def test_object_key(spark):
    def key(c):
        return cards.object_key(c, F.lit("m20"), F.lit("150"), F.lit("Fire/Ice"), 1)

    values = ["Core: Set?", None]
    assert apply(spark, key, values) == [
        "Core_ Set_ - m20/150-Fire_Ice_face1.png",
        "unknown - m20/150-Fire_Ice_face1.png",
    ]


def test_faces_and_pictures(make):
    feed = make.feed(
        {"faces": ["f0", "f1"]},
        {"faces": ["f0", None], "png": "top"},
        {"faces": ["f0"]},
        {"png": "top"},
        {},
    )
    shown = feed.orderBy("feed_seq").select(
        cards.face_count().alias("n"), cards.png_url(0).alias("p0"), cards.png_url(1).alias("p1")
    )
    assert column(shown, "n") == [2, 1, 1, 1, 1]
    assert column(shown, "p0") == ["f0", "top", "f0", "top", None]
    assert column(shown, "p1") == ["f1", None, None, None, None]
