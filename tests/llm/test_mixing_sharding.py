import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curioledger.llm import mixing, sharding


def size_of(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_targets():
    assert mixing.targets({"b": 100, "a": 100, None: 100}) == pytest.approx({"a": 187.5, "b": 75, None: 37.5})
    # What a small source cannot give goes to the others by weight.
    assert mixing.targets({"a": 1, "b": 99, "c": 100}) == pytest.approx({"a": 3, "b": 197 * 2 / 3, "c": 197 / 3})
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0, "b": 5}) == {"a": 0, "b": 5}


@pytest.mark.parametrize("size", [1, 2, 97, 1000])
def test_permutations(spark, size):
    frame = spark.range(size).select(
        mixing.permuted(F.col("id"), F.lit(size), F.lit(1)).alias("p"),
        mixing.permuted(F.col("id"), F.lit(size), F.lit(2)).alias("q"),
    )
    rows = frame.collect()
    assert sorted(r["p"] for r in rows) == sorted(r["q"] for r in rows) == list(range(size))
    assert size < 90 or [r["p"] for r in rows] != [r["q"] for r in rows]


def test_given_documents_are_mixed(sample):
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    sources = {r["doc_id"]: r["source"] for r in sample.collect()}
    rows = mixing.mixed_sizes(sample).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {k: size_of(t) for k, t in texts.items()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        source = sources[r["doc_id"]]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert target == pytest.approx(mixing.targets(dict(sizes)))
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + mixing.BLOCK_WORDS for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed_sizes(sample).collect()))
    copies = mixing.mixed_documents(sample)
    assert copies.columns == sample.columns
    words = Counter()
    for r in copies.collect():
        words[r["doc_id"]] += size_of(r["text"])
        assert r["n_chars"] == len(r["text"]) and r["source"] == sources[r["doc_id"]]
    assert words == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_odd_tables_are_mixed(odd_docs):
    rows = mixing.mixed_sizes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(
        (r["doc_id"], size_of(r["text"])) for r in odd_docs.collect()
    )
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    copies = mixing.mixed_documents(odd_docs)
    assert copies.columns == odd_docs.columns
    assert sum(size_of(r["text"]) for r in copies.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mixed_sizes(odd_docs.limit(0)).count() == 0
    assert mixing.mixed_documents(odd_docs.limit(0)).count() == 0


def test_matrix_has_both_sums():
    sizes = [0, 1, 17, 300, 4, 0, 55]
    matrix = sharding.communication_matrix(sizes, 16)
    assert matrix.sum(axis=1).tolist() == sizes
    columns = matrix.sum(axis=0)
    assert columns.max() - columns.min() <= 1


def placed(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(16))


def test_given_documents_are_sharded(sample):
    texts = {r["doc_id"]: r["text"].encode() for r in sample.collect()}
    rows = sharding.sharded_documents(sample.repartition(7)).collect()
    placed(rows)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        k: (len(t) + 1, zlib.crc32(t)) for k, t in texts.items()
    }


def test_odd_tables_are_sharded(odd_docs, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 1)
    rows = sharding.sharded_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    placed(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sharding.sharded_documents(odd_docs.limit(0)).count() == 0
    whole = sharding.shuffled(odd_docs, 3)
    assert set(whole.columns) == set(odd_docs.columns)
    assert whole.select("shard").distinct().count() == 3


def test_places_look_uniform(spark):
    rows = sharding.shuffled(spark.range(16_000).repartition(5), 16).toPandas()
    # Neighbours end in the same shard as often as chance has it.
    shard = rows.sort_values("id").shard.to_numpy()
    assert abs((shard[1:] == shard[:-1]).mean() - 1 / 16) < 0.01
    assert abs(np.corrcoef(rows["id"], rows["slot"])[0, 1]) < 0.05
