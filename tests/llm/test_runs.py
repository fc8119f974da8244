"""Periodic runs against all periods tried word by word."""

import hashlib
import random
import re
import zlib

import pytest

from curioledger.llm import runs


def plain_runs(words, least=24, periods=3):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((start, length, q) for (start, length), q in found.items())


def plain_collapsed(words, found):
    kept = [True] * len(words)
    for start, length, q in found:
        kept[start + q : start + length] = [False] * (length - q)
    return " ".join(w for w, k in zip(words, kept, strict=True) if k)


def made(rng):
    kind, n = rng.randrange(6), rng.randrange(300)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        base = [rng.choice("abcd") for _ in range(rng.randrange(1, 60))]
        edge = [rng.choice("xyz") for _ in range(rng.randrange(30))]
        return edge + (base * 300)[:n] + edge[::-1]
    if kind == 3:
        words = ([rng.choice("ab") for _ in range(rng.randrange(1, 12))] * 300)[:n]
        if words:
            words[rng.randrange(n)] = "q"
        return words
    if kind == 4:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    return [f"w{rng.randrange(4000)}" for _ in range(n)] + ["z y x"] * rng.randrange(12)


@pytest.mark.parametrize("shared", [1, 500, 1 << 20])
def test_runs_are_those_of_all_periods(shared):
    rng = random.Random(shared)
    texts = [" ".join(made(rng)) for _ in range(150)]
    found = runs.runs_of([t.encode() for t in texts], shared_words=shared)
    for text, (got, _) in zip(texts, found, strict=True):
        assert [tuple(r) for r in got.tolist()] == plain_runs(text.split()), text


def test_other_thresholds():
    words = (["a", "b", "c"] * 9)[:26]
    assert [tuple(r) for r in runs.runs_of([" ".join(words).encode()], 26)[0][0].tolist()] == [(0, 26, 3)]
    assert not len(runs.runs_of([" ".join(words).encode()], 27)[0][0])
    assert not len(runs.runs_of([" ".join(words).encode()], 24, 9)[0][0])
    with pytest.raises(ValueError):
        runs.runs_of([b"a"], 10)


def test_chunks_of_blocks_do_not_matter(monkeypatch):
    words = ([f"w{k}" for k in range(37)] * 40)[:1200]
    whole = runs.runs_of([" ".join(words).encode()])[0][0].tolist()
    monkeypatch.setattr(runs, "CHUNK", 64)
    assert runs.runs_of([" ".join(words).encode()])[0][0].tolist() == whole == [[0, 1200, 37]]


def test_a_long_text_of_one_word():
    found = runs.runs_of([b"a " * 60_000 + b"b " + b"a " * 60_000])[0][0].tolist()
    assert found == [[0, 60_000, 1], [60_001, 60_000, 1]]


def planted(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digests(doc_id, text):
    words = planted(doc_id, text)
    found = plain_runs(words)
    best = None
    for start, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, plain_collapsed(words, found))]
    return (doc_id, len(found), *shown, *sha)


def test_digests_of_given_documents(sample):
    docs = sample.filter("length(text) < 6000")
    got = {tuple(r) for r in runs.run_digests(docs).collect()}
    assert got == {digests(r["doc_id"], r["text"]) for r in docs.collect()}
    assert sum(r[1] for r in got) > 10


def test_odd_tables(odd_docs, spark):
    short = odd_docs.filter("text is null or length(text) < 6000")
    got = sorted(map(str, (tuple(r) for r in runs.run_digests(short).collect())))
    assert got == sorted(map(str, (digests(r["doc_id"], r["text"]) for r in short.collect())))
    assert runs.run_digests(odd_docs).count() == odd_docs.count()
    assert runs.run_digests(odd_docs.limit(0)).count() == 0
    whole = runs.periodic_runs(odd_docs)
    # A column of the table that has the name of the result gives way to it.
    assert whole.columns == [*(c for c in odd_docs.columns if c != "found"), "found"]
    text = "x y " * 20 + "\x0b z\t"
    docs = spark.createDataFrame([(None, text)], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert row.found.collapsed == "x y z" and [tuple(r) for r in row.found.runs] == [(0, 40, 2)]
