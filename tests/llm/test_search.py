"""Ranked lexical search and nearest vectors against everything scored."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curioledger.llm import lexical, neighbours

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain_search(docs, items, most=20):
    counted = [(d, terms(t)) for d, t in docs]
    n_docs = sum(1 for _, t in counted if t)
    total = sum(len(t) for _, t in counted)
    df = Counter(w for _, t in counted for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for doc, found in counted:
            if not found:
                continue
            tf, m = Counter(found), 75 + 25 * len(found) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m))
                for w in terms(text)
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def found(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    return docs, items, plain_search(map(tuple, docs.collect()), map(tuple, items.collect()))


def test_search_of_given_tables(given):
    docs, items, expected = given
    assert found(lexical.ranked_search(docs, items)) == expected


def test_buckets_heads_and_blocks_change_nothing(given, monkeypatch):
    docs, items, expected = given
    monkeypatch.setattr(lexical, "HEAD_ROWS", 50)
    monkeypatch.setattr(lexical, "HEAD_SHARE", 0.1)
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 7)
    assert found(lexical.ranked_search(docs, items, block_terms=400)) == expected


def test_bounds_leave_work_undone():
    """Buckets and candidates are pruned, and nothing that reaches the threshold is."""
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 9000, 60)
    scale = np.sqrt(weights.astype(float))
    rows = [np.sort(rng.choice(60, rng.integers(1, 30), replace=False)).astype(np.int32) for _ in range(300)]
    impacts = [rng.integers(1, 900_000, len(r)) for r in rows]
    norms = [float(np.sqrt(((i * scale[r]) ** 2).sum())) for r, i in zip(rows, impacts, strict=True)]
    batch = lexical.pa.RecordBatch.from_arrays(
        [lexical.pa.array(range(300)), lexical._bytes(rows), lexical._bytes(impacts), lexical.pa.array(norms)],
        ["doc_id", "numbers", "impacts", "norm"],
    )
    bucket = lexical._Bucket(batch, scale)
    numbers = np.array([3, 8, 21, 40, 55], np.int32)
    dense = np.zeros(60, np.int64)
    dense[numbers] = weights[numbers]
    scores = np.array([(dense[r] * i).sum() for r, i in zip(rows, impacts, strict=True)])
    least = int(np.sort(scores)[-5])
    item = lexical._Item(0, numbers, np.ones(5, np.int64), weights, least)
    near = bucket.candidates(item)
    assert set(np.flatnonzero(scores >= least)) <= set(near.tolist()) and len(near) < 150
    assert (bucket.exact(near, dense) == scores[near]).all()
    item.least = int(item.norm * bucket.longest * 1.01)
    assert not lexical._may_reach(item, bucket)


def test_odd_texts_and_items(spark, odd_docs):
    items = [(1, "one two THREE one"), (2, None), (3, "é😀 token"), (None, "stone1"), (1, "nothing-known"), (1, "one two THREE one")]
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    pairs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows = found(lexical.ranked_search(odd_docs, items))
    asked = {(r["item_id"], r["text"]) for r in items.collect()}
    assert rows == plain_search(pairs, sorted(asked, key=str))
    assert lexical.ranked_search(odd_docs.limit(0), items).count() == 0
    assert lexical.ranked_search(odd_docs, items.limit(0)).count() == 0


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in range(60, 0, -1)] + [(99, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "words")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.ranked_search(docs, items).orderBy("rank").collect()] == list(range(1, 21))


def plain_nearest(rows, most=20):
    rows = sorted({(k, tuple(v)) for k, v in rows})
    ids, vectors = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for k in sorted({int(i) for i in ids if i % 20 == 0}):
        near = []
        for own in vectors[ids == k]:
            scores = (vectors * own).sum(axis=1)
            near += [(-s, int(i)) for s, i in zip(scores, ids, strict=True) if i != k]
        out[k] = sorted(near)[:most]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(own)
    return out


def asked(vec_id="vec_id"):
    return F.col(vec_id) % 20 == 0


def test_recall_of_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").filter("vec_id < 6000")
    exact = plain_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    got = by_query(neighbours.nearest(rows, asked()))
    assert got.keys() == exact.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for _, i in got[k]} & {i for _, i in exact[k]}) for k in exact]
    assert sum(hits) / (20 * len(hits)) >= 0.9
    # Scores are those of the original vectors, nearest first, ties to the smaller id.
    assert all(v == sorted(v) for v in got.values())
    truth = {k: dict((i, s) for s, i in v) for k, v in exact.items()}
    for k, own in got.items():
        assert all(s == pytest.approx(truth[k][i], abs=1e-15) for s, i in own if i in truth[k])


def test_small_tables_are_exact_in_all_forms(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), rng.normal(size=6).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[40][1]) for k in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = plain_nearest(rows)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 32)
    for options in ({}, {"query_block": 4}, {"first_slices": 4}):
        got = by_query(neighbours.nearest(docs, asked(), **options))
        assert got.keys() == exact.keys()
        for k, own in exact.items():
            assert [i for _, i in got[k]] == [i for _, i in own], (options, k)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, [None, 1.0]), (6, []), (7, [2.0, 0.5]), (7, [2.0, 0.5]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 4.0]),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1))
    got = by_query(neighbours.nearest(docs, asked()))
    assert got == {0: [(-2.0, 7), (-1.0, 20), (1.0, 9)], 20: [(-2.0, 7), (-1.0, 0), (1.0, 9)]}
    assert neighbours.nearest(docs.limit(0), asked()).count() == 0
    assert neighbours.nearest(docs.filter("vec_id = 0"), asked()).count() == 0


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(1)
    prefixes = np.array([rng.permutation(12)[:5] for _ in range(40)], np.uint16)
    files = neighbours.InvertedFiles(prefixes, 12)
    for own in prefixes[:5]:
        place = {p: k for k, p in enumerate(own)}
        for row, found in zip(prefixes, files.footrule(own), strict=True):
            other = {p: k for k, p in enumerate(row)}
            assert found == sum(abs(place.get(p, 5) - other.get(p, 5)) for p in place.keys() | other.keys())


def test_footrule_of_prefixes_too_long_for_short_numbers():
    prefixes = np.array([np.roll(np.arange(300), k) for k in (0, 1, 150)], np.uint16)
    found = neighbours.InvertedFiles(prefixes, 300).footrule(prefixes[0])
    place = np.argsort(prefixes, axis=1).astype(int)
    assert found.tolist() == np.abs(place - place[0]).sum(axis=1).tolist()


def test_rows_are_compared_exactly_only_where_they_can_be_best(monkeypatch):
    """The search measures few of the rows within the cut, and finds what measuring all of them finds."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16))
    vectors[1000:1040] = vectors[7]
    kept = neighbours._may_be_best(vectors, vectors[7], 20, neighbours._longest(vectors))
    scores = (vectors * vectors[7]).sum(axis=1)
    assert set(np.flatnonzero(scores >= np.sort(scores)[-20])) <= set(kept) and len(kept) < 100
    # Products that overflow or vanish are no bound.
    for scale in (1e200, 1e-160):
        odd = vectors * scale
        assert len(neighbours._may_be_best(odd, odd[7], 20, neighbours._longest(odd))) == 3000
    prefixes = neighbours.nearest_pivots(vectors, vectors[:32], 16)
    block = {"query": [7, 8], "vector": list(vectors[7:9]), "prefix": list(prefixes[7:9]), "cut": [200, 10**6], "least": [-np.inf, 0.5]}
    columns = [pa.array([[k, k + 5000] for k in range(3000)]), neighbours._packed(vectors), neighbours._packed(prefixes)]
    batch = pa.RecordBatch.from_arrays(columns, ["ids", "vec", "prefix"])
    search = neighbours._searcher(block, 32, 20, 3000)
    fast = [b.to_pydict() for b in search(iter([batch]))]
    monkeypatch.setattr(neighbours, "_may_be_best", lambda vectors, *_: np.arange(len(vectors)))
    assert fast == [b.to_pydict() for b in search(iter([batch]))]
