"""What the mix takes of each document, from the same draws made in plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curioledger.llm import mixing


def test_counts_are_whole_multinomials(spark):
    """Every slot draws by its own hash; shares are met as far as chance has it."""
    slots = 10_000
    waves = [(60_000, 4000, mixing._shares({0: 3000, 1: 0, 2: 1000})), (64_000, 6000, mixing._shares({0: 300, 2: 100}))]
    found = {(r["shard"], r["number"]): r["n"] for r in mixing.drawn_counts(spark, waves).collect()}
    marks = spark.range(60_000, 60_000 + slots).select("id", F.xxhash64("id", F.lit(mixing.SEED)).alias("mark")).collect()
    plain = Counter()
    for r in marks:
        draw = (r["mark"] % (1 << 52)) / (1 << 52)
        plain[r["id"] // mixing.SHARD_SLOTS, 0 if draw < 0.75 else 2] += 1
    assert found == plain
    assert sum(found.values()) == slots and len({k for k, _ in found}) == 2
    share = sum(n for (_, k), n in found.items() if k == 0) / slots
    assert 0.001 < abs(share - 0.75) + 0.002 < 5 * math.sqrt(0.75 * 0.25 / slots)


@pytest.mark.parametrize("tail", [16, 16_384])
def test_waves_bring_sources_to_what_they_need(spark, monkeypatch, tail):
    """Whether the last waves are counted by the cluster or from collected draws, they are the same."""
    monkeypatch.setattr(mixing, "TAIL_SLOTS", tail)
    recipe = [(0, 4000, 5000), (1, 100_000, 20_000), (2, 900, 300)]
    rows = mixing._slots(recipe, spark).groupBy("number").agg(
        F.count("*").alias("n"), F.countDistinct("block").alias("blocks"), F.max("block").alias("last")
    )
    counts = {}
    for r in rows.collect():
        counts[r["number"]] = r["n"]
        _, blocks, wanted = recipe[r["number"]]
        assert abs(r["n"] - wanted) <= 20 and r["last"] < blocks
        # Within one pass no block comes twice.
        assert r["blocks"] == min(r["n"], blocks)
    assert mixing._waves(recipe, spark)[-1][1] <= mixing.LAST_SLOTS and sum(counts.values()) == 25_300


@pytest.mark.parametrize("words", [40, 700])
def test_taken_words_follow_from_the_drawn_blocks(spark, words):
    rows = [(k, " ".join(f"w{i}" for i in range(words + 13 * k)), "ab"[k % 2], k) for k in range(30)]
    rows += [(None, "one two three", "b", 1), (None, "one two three", "a", 2), (5, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    pieces, sized, sources = mixing.mix(docs)
    pieces = pieces.collect()
    uses = {(r["number"], r["block"]): r["uses"] for r in pieces}
    # Documents lie one after the other in their source, without gap or overlap within a bucket.
    placed = {(r["number"], r["start"], r["size"], r["doc_id"]) for r in pieces}
    taken = Counter()
    for number, start, n, doc_id in placed:
        for word in range(start, start + n):
            taken[doc_id, n] += uses[number, word // mixing.BLOCK_WORDS]
    found = Counter()
    for r in mixing.mixed_sizes(docs).collect():
        found[r["doc_id"], r["size"]] += r["taken"]
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in taken.items() if v}
    spans = sorted((number, start, start + n) for number, start, n, _ in placed)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    assert sized.count() == len(rows) and sources.count() == 3


def test_rows_keep_their_own_columns(spark):
    """Equal id and text under other sources, and equal rows, each come back as they are."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(None, text, "a", "x"), (None, text, "b", "y"), (None, text, "b", "y"), (7, text, "a", "z"), (7, text, "a", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string")
    copies = mixing.mixed_documents(docs).collect()
    words = Counter()
    for r in copies:
        words[r["doc_id"], r["source"], r["_key"]] += len(r["text"].split())
    assert set(words) <= {(r[0], r[2], r[3]) for r in rows}
    sizes = Counter()
    for r in mixing.mixed_sizes(docs).collect():
        sizes[r["doc_id"]] += r["taken"]
    for doc_id in (None, 7):
        assert sum(n for (k, _, _), n in words.items() if k == doc_id) == sizes[doc_id]


def test_hot_equal_rows_are_salted(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_ROWS", 3)
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(None, text, "a")] * 20 + [(1, text, "b")] * 2, "doc_id long, text string, source string")
    sizes = [r["taken"] for r in mixing.mixed_sizes(docs).collect()]
    copies = [len(r["text"].split()) for r in mixing.mixed_documents(docs).collect()]
    assert sum(sizes) == sum(copies) and len(sizes) == 22


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    docs = spark.createDataFrame([(k, "a b", str(k)) for k in range(3)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="at most 2 sources"):
        mixing.mixed_sizes(docs).collect()
