from functools import cmp_to_key

import pytest
from conftest import column, money, rows_of
from pyspark.sql import functions as F

from curioledger.operators import grid as G
from curioledger.operators.holdings import with_set_name
from curioledger.plans import ordering


def test_filters(make):
    held = make.holdings(
        {"id": 1, "card_name": "Hot Ring", "language": "English", "set_code": "a", "quantity": 2},
        {"id": 2, "card_name": "ring", "language": None, "set_code": "A", "foil": True},
        {"id": 3, "card_name": "Bolt", "language": "pt", "set_code": "a", "foil": True},
    )

    def found(**fields):
        return sorted(column(G.filter_holdings(held, **fields), "id"))

    assert found() == found(name=" ", quantity=-1) == [1, 2, 3]
    assert found(name=" RING ") == [1, 2]
    assert found(language="ENG") == [1] and found(language="n") == [1]
    assert found(set_code=" a ") == [1, 3]
    assert found(quantity=2) == [1] and found(foil_only=True) == [2, 3]
    assert found(name="ring", foil_only=True) == [2]


def test_nulls_last_then_first(make):
    held = make.holdings({"id": 1}, {"id": 2, "price": money("2")}, {"id": 3, "price": money("10")})
    assert column(G.sort_grid(held, "price"), "id") == [2, 3, 1]
    assert column(G.sort_grid(held, "price", desc=True), "id") == [1, 3, 2]


def test_text_and_booleans(make):
    held = make.holdings(
        {"id": 1, "card_number": "10", "foil": True}, {"id": 2, "card_number": "2a"},
        {"id": 3, "card_number": "É", "foil": True}, {"id": 4, "card_number": "f"},
        {"id": 5, "card_number": "e"},
    )
    sorted_rows = G.sort_grid(held, "card_number")
    assert column(sorted_rows, "id") == [2, 1, 3, 5, 4]
    assert sorted_rows.columns == held.columns
    assert column(G.sort_grid(held, "foil"), "id") == [2, 4, 5, 1, 3]
    by_length = F.length("card_number")
    assert column(G.sort_grid(held, "card_number", key_expr=by_length), "id") == [3, 4, 5, 1, 2]


def test_by_set_name(make):
    held = make.holdings(
        {"id": 1, "set_code": "zzz"}, {"id": 2, "set_code": "a"}, {"id": 3, "set_code": "mid"}
    )
    named = with_set_name(held, make.sets({"set_code": "zzz", "set_name": "Alpha"},
                                          {"set_code": "a", "set_name": "Zeta"}))
    assert column(G.sort_grid(named, "set_name"), "id") == [1, 3, 2]


def test_pages(spark):
    rows = spark.range(60)
    first = G.paginate(rows, "id", 1, 25)
    assert (first.total, first.page_count, first.page) == (60, 3, 1)
    assert column(first.rows, "id") == list(range(25))
    last = G.paginate(rows, "id", 99, 25, desc=True)
    assert last.page == 3 and column(last.rows, "id") == list(range(9, -1, -1))
    empty = G.paginate(rows.filter("id < 0"), "id", 5, 50)
    assert (empty.total, empty.page_count, empty.page) == (0, 1, 1)
    with pytest.raises(ValueError):
        G.paginate(rows, "id", 1, 30)


def test_deep_pages_and_long_heads_use_the_numbering(spark, monkeypatch):
    rows = spark.range(5000).withColumn("k", F.col("id") % 7)
    order = [F.col("k").desc(), F.col("id")]
    expected = rows_of(ordering.rows_between(rows, order, 4000, 25), "id")
    numbered = ordering.number_head(rows, order, 30, "n")
    head = rows_of(ordering.head(rows, order, 30), "id")
    monkeypatch.setattr(ordering, "HEAD_ROWS", 10)
    assert rows_of(ordering.rows_between(rows, order, 4000, 25), "id") == expected
    assert rows_of(ordering.head(rows, order, 30), "id") == head
    again = ordering.number_head(rows, order, 30, "n")
    assert sorted(rows_of(again, "n", "id")) == sorted(rows_of(numbered, "n", "id"))


def test_numbering_is_complete_with_a_hot_key(spark):
    rows = spark.range(30000, numPartitions=16).withColumn(
        "k", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11)
    )
    numbered = ordering.with_ordinal(rows, [F.col("k").desc(), F.col("id")]).collect()

    def compare(a, b):
        return (b.k - a.k) or (a.id - b.id)

    expected = sorted(numbered, key=cmp_to_key(compare))
    assert [r.ordinal for r in expected] == list(range(1, 30001))


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("key", ["number", "text", "hot"])
def test_middle_pages_sort_their_range_alone(spark, monkeypatch, key, desc):
    """Nulls, ties, texts and a hot key; whatever range the page falls into."""
    monkeypatch.setattr(ordering, "PROBE_ROWS", 40)
    monkeypatch.setattr(ordering, "RANGES", 8)
    rows = spark.range(3000, numPartitions=5).select(
        "id",
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") * 7919) % 1009).alias("number"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("Ärt "), (F.col("id") * 31 % 500).cast("string"))).alias("text"),
        F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 11).alias("hot"),
    )
    whole = column(G.sort_grid(rows, key, desc), "id")
    for page in (1, 9, 15, 16, 28, 30):
        found = G.paginate(rows, key, page, 100, desc, head_rows=120, ranged_rows=0)
        assert (found.total, found.page_count) == (3000, 30)
        assert column(found.rows, "id") == whole[100 * (page - 1) : 100 * page], page


def test_a_middle_page_is_found_without_a_sort_of_the_rest(spark):
    rows = spark.range(50_000, numPartitions=4).withColumn("k", F.col("id") * 7919 % 50_021)
    page = G.paginate(rows, "k", 200, 100, head_rows=2000, ranged_rows=49_999).rows
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrderedAndProject" in plan and "settled" not in plan
    assert column(page, "k") == column(rows.orderBy("k").offset(19_900).limit(100), "k")


def test_rounds_of_a_deep_page_do_not_compute_the_table_again(spark):
    """The table is read for its two columns and for the page, however many rounds there are."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(4000).mapInPandas(counted, "id long")
    keyed = rows.select("id", (F.col("id") % 7).alias("key"))
    found = ordering.rows_of_range(keyed, "key", "id", 2000, 5, 4000, head_rows=10)
    expected = sorted(range(4000), key=lambda k: (k % 7, k))[2000:2005]
    assert [r["id"] for r in found.collect()] == expected
    assert seen.value == 8000
