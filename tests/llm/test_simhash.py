import re

import numpy as np
import pytest
import xxhash

from curioledger.llm import similar, simhash
from curioledger.llm.components import connected_components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and top(i) != top(j):
                parent[top(i)] = top(j)
    least = {}
    for k, key in enumerate(ids):
        least[top(k)] = min(key, least.get(top(k), key))
    return [least[top(k)] for k in range(len(ids))]


def test_given_documents(sample):
    rows = {r["doc_id"]: r["text"] for r in sample.collect()}
    found = {r["doc_id"]: r for r in simhash.near_duplicates(sample).collect()}
    ids = sorted(rows)
    fps = [plain_fingerprint(rows[k]) for k in ids]
    assert [int(found[k]["fingerprint"], 16) for k in ids] == fps
    assert [found[k]["component_id"] for k in ids] == plain_components(ids, fps)


def test_odd_table(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["fingerprint"] == of[2]["fingerprint"] == of[3]["fingerprint"] == "0" * 16
    assert of[1]["component_id"] == of[2]["component_id"] == of[3]["component_id"] == 1
    assert of[5]["component_id"] == 4
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    kept = similar.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sum(r["doc_id"] is None for r in rows) == 2
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and {1, 4, 7} <= set(ids) and not {2, 3, 5} & set(ids)


@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_blocks_against_pairs(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fps = centres[rng.integers(0, 60, 700)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) * (rng.random(700) < 0.6).astype(np.uint64)
    group = np.sort(rng.integers(0, 12, 700))
    pairs = simhash.linked(group, fps, radius)
    assert all(group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius for i, j in pairs)
    # As many trees as components, so every link is inside one.
    whole = [len(set(plain_components(range((group == g).sum()), [int(x) for x in fps[group == g]], radius))) for g in range(12)]
    assert 700 - len(pairs) == sum(whole)


def test_large_keys_are_cut_into_tasks(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (500, 2))})
    fps += [int(x) for x in rng.integers(0, 1 << 62, 200)]
    nodes = spark.createDataFrame([(k, fp) for k, fp in enumerate(fps)], "node long, fp long")
    for size in (16, 8192):
        labels = connected_components(simhash.links(nodes, 4, size)).collect()
        root = {r["node"]: r["root"] for r in labels}
        assert [root.get(k, k) for k in range(len(fps))] == plain_components(range(len(fps)), fps)


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(7, k) for k in range(8, 60)]
    edges = spark.createDataFrame(chain + hub + [(7, 8), (9, 9), (300, 299)], "u long, v long")
    root = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert {root[k] for k in range(100, 161)} == {100}
    assert {root[k] for k in range(7, 60)} == {7}
    assert root[300] == root[299] == 299
    assert connected_components(edges.limit(0)).count() == 0


def test_links_go_by_fingerprint_and_not_by_id(spark, monkeypatch):
    """Texts stand for fingerprints; one without a doc_id links, one doc_id with two joins nothing."""
    far, mid = (1 << 60) - 1, 0x0F0F0F0F0F0F0F0F
    rows = [(None, 0b1111), (2, 0), (3, 0b11111111), (5, far), (5, mid), (6, far ^ 1), (7, mid ^ 1)]
    marked = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    found = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in simhash.near_duplicates(marked).collect()}
    assert found[None, 0b1111] == found[2, 0] == found[3, 0b11111111] == 2
    assert found[5, far] == found[6, far ^ 1] == 5
    assert found[7, mid ^ 1] == 5
    alone = spark.createDataFrame([(1, 0), (1, far), (9, far), (4, far ^ 3), (0, 1 << 40)], "doc_id long, fp long")
    found = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in simhash.near_duplicates(alone).collect()}
    assert found[1, 0] == found[0, 1 << 40] == 0
    assert found[1, far] == found[9, far] == found[4, far ^ 3] == 1
