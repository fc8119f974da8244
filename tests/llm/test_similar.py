import random
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from curioledger.llm import similar
from curioledger.plans.lineage import settle

from .conftest import prose


def plain_shingles(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_least(rows, least=0.8):
    """The smallest id of each row's group, of all pairs compared."""
    root = {k: k for k, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = [(k, plain_shingles(t)) for k, t in rows]
    for (i, a), (j, b) in combinations(sets, 2):
        if min(len(a), len(b)) >= least * max(len(a), len(b)) and similarity(a, b) >= least:
            low, high = sorted((top(i), top(j)))
            root[high] = low
    return {top(k) for k in root}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_stage_keeps_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == plain_least([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_changed_words(spark):
    words = prose(1, 104).split()
    near = [*words[:40], "new", *words[41:]]
    nearer = words[:90]
    far = [w if k % 20 else "other" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(nearer)), (4, " ".join(far)), (5, prose(2, 104))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in similar.one_of_each(docs).collect()} == plain_least(rows) == {1, 4, 5}


def grouped(docs, *limits):
    texts = docs.withColumn("hash", F.xxhash64("text"))
    signed = settle(texts.select("doc_id", "hash", similar._signed(5)(F.col("text").cast("binary")).alias("sign")))
    return similar.similar_groups(signed, texts, 5, 0.8, *limits)


def edits(copies, words=204, changed=3):
    """A text and copies with other words in a few places, most of them unlike each other."""
    rng = random.Random(copies)
    text = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = [(0, " ".join(text))]
    for k in range(1, copies):
        own = list(text)
        for at in rng.sample(range(words), changed):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    return rows


def test_work_of_a_group_grows_with_its_rows(spark, monkeypatch):
    """Edges and what travels for them, for four times the copies: about four times as many."""
    made = {}
    round_links = similar._round_links

    def counted(rows, facts, sets, least, *limits):
        edges = round_links(rows, facts, sets, least, *limits)
        made[size] = made.get(size, 0) + edges.count() + rows.count()
        return edges

    monkeypatch.setattr(similar, "_round_links", counted)
    for size in (400, 1600):
        docs = spark.createDataFrame(edits(size), "doc_id long, text string").repartition(4)
        assert grouped(docs).select("root").distinct().count() == 1
    assert made[1600] < 6 * made[400] and made[1600] < 1600 * similar.BANDS * 1.5


def test_repeated_rows_and_rows_without_an_id(spark):
    text, other = prose(8, 60), prose(9, 60)
    rows = [(3, text, "a"), (3, text, "a"), (3, text, "b"), (4, text, "c"), (None, text, "d"), (5, None, "e"), (6, "", "f"), (7, other, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    kept = similar.one_of_each(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 3, 5, 7]
    assert similar.one_of_each(docs.limit(0)).count() == 0


def test_a_star_whose_copies_are_unlike_each_other(spark):
    """The centre is not the first of every band, so it is found in the second step; large keys are cut."""
    words = prose(3, 104).split()
    rows = [(0, " ".join(words))]
    for k in range(1, 40):
        own = list(words)
        own[2 * k % 100], own[(2 * k + 51) % 100] = f"x{k}", f"y{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in ((4, 4_000_000), (8192, 250), (8192, 4_000_000)):
        roots = grouped(docs, *limits)
        assert roots.select("root").distinct().count() == 1 and roots.count() == 40
    assert len(plain_least(rows)) == 1


def test_unlike_texts_under_one_id_both_have_a_say(spark):
    rows = [(1, prose(5, 60)), (1, prose(6, 60)), (2, prose(6, 60)), (3, prose(7, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in similar.one_of_each(docs).collect())
    assert kept == sorted([rows[0], rows[1], rows[3]])


def test_copies_are_found_by_their_fingerprints(spark, monkeypatch):
    """Without any round of bands, the fingerprints alone connect copies with a word changed."""
    monkeypatch.setattr(similar, "ROUNDS", ())
    docs = spark.createDataFrame([*edits(40, words=1000, changed=1), (40, prose(3, 104))], "doc_id long, text string")
    roots = {r["node"]: r["root"] for r in grouped(docs).collect()}
    assert len(roots) == 40 and len(set(roots.values())) < 10


def test_fingerprints_alone_link_nothing(spark):
    """Pairs that fingerprints name are compared by their sets."""
    a, b, c = (similar.shingles(t.encode(), 5).tobytes() for t in (prose(1, 104), prose(1, 100), prose(2, 104)))
    sets = spark.createDataFrame([(1, a), (2, b), (3, c)], "node long, set binary")
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "u long, v long")
    assert [tuple(r) for r in similar._verified(pairs, sets, 0.8).collect()] == [(2, 1)]
