import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curioledger.llm import packing
from curioledger.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    whole = Tokenizer.from_file(PATH)
    return [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer(sample):
    rng = random.Random(1)
    texts = [r["text"] for r in sample.collect()]
    texts += ["", " ", "a  b   c ", "\n \n", "a\x1c b\x1c", "x<|endoftext|> y", "it's   don't　z", "a\x85 b", "😀 é"]
    texts += ["".join(rng.choice(" \n\taé1'. \x1c😀s") for _ in range(rng.randrange(25))) for _ in range(500)]
    encoder = Encoder(PATH)
    for text, ids in zip(texts, ids_of(texts), strict=True):
        assert encoder.packed(text) == array("I", ids).tobytes()


def held(pieces, ids_by_row):
    """Pieces cover every row once, checksums hold, offsets are gapless, padding is as bounded."""
    sequences = defaultdict(list)
    covered = Counter()
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        covered[(p["doc_id"], p["doc_tokens"])] += p["length"]
    for (_, tokens), n in covered.items():
        assert n % tokens == 0
    padded = 0
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
            ids = ids_by_row[p["doc_id"], p["doc_tokens"]]
            assert zlib.crc32(array("I", ids[p["start"] : p["start"] + p["length"]]).tobytes()) == p["ids_crc32"]
        assert at <= packing.WINDOW and all(p["tier"] >= at for p in own)
        padded += at & (at - 1) != 0
    return padded


@pytest.mark.parametrize("group_docs", [8192, 40])
def test_given_documents(sample, group_docs):
    rows = sample.collect()
    ids = [i + [0] for i in ids_of([r["text"] for r in rows])]
    by_row = {(r["doc_id"], len(i)): i for r, i in zip(rows, ids, strict=True)}
    pieces = packing.pack(sample, PATH, group_docs).collect()
    assert held(pieces, by_row) <= -(-len(rows) // group_docs)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    steps = defaultdict(set)
    for p in pieces:
        steps[p["step_id"]].add(p["sequence_id"])
    assert max(map(len, steps.values())) <= packing.STEP_SEQUENCES


def test_odd_table(odd_docs):
    rows = odd_docs.collect()
    ids = [i + [0] for i in ids_of([r["text"] or "" for r in rows])]
    by_row = {(r["doc_id"], len(i)): i for r, i in zip(rows, ids, strict=True)}
    pieces = packing.pack(odd_docs, PATH).collect()
    held(pieces, by_row)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0


def test_every_tier_has_windows_of_its_own():
    """Rests open windows of their tier; all but one sequence end full at a power of two."""
    rng = random.Random(9)
    for rests in ([rng.randint(20, 1000) for _ in range(4000)], [rng.randint(130, 400) for _ in range(3000)]):
        sequences = packing.plan(list(rests))
        totals = Counter(sum(n for _, _, n in own) for own in sequences)
        assert sum(n for t, n in totals.items() if t & (t - 1)) <= 1
        assert sum(n * t for t, n in totals.items()) == sum(rests)
        carried = {t: n for t, n in totals.items() if t in packing.TIERS}
        assert len([t for t in carried if carried[t] >= 20]) > 1, carried
        # A window is of the tier of the longest piece that opened it, or cut to a power of two.
        for own in sequences:
            total = sum(n for _, _, n in own)
            assert max(n for _, _, n in own) <= total <= packing.WINDOW


def test_equal_rows_are_dealt_apart(spark):
    docs = spark.createDataFrame([(None, None)] * 600, "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, PATH, 50)
    groups = Counter(r["sequence_id"] >> 32 for r in pieces.collect())
    assert sum(groups.values()) == 600 and len(groups) > 6 and max(groups.values()) < 150


def test_plans_lose_nothing():
    rng = random.Random(2)
    for turn in range(120):
        top = rng.choice([40, 600, 1023])
        rests = [rng.randint(0 if turn % 2 else top // 2, top) for _ in range(rng.randrange(200))]
        sequences = packing.plan(rests)
        parts = defaultdict(list)
        for own in sequences:
            assert 0 < sum(n for _, _, n in own) <= packing.WINDOW
            for row, start, n in own:
                parts[row].append((start, n))
        for row, rest in enumerate(rests):
            at = 0
            for start, n in sorted(parts[row]):
                assert start == at
                at += n
            assert at == rest
        totals = [sum(n for _, _, n in own) for own in sequences]
        assert sum(t & (t - 1) != 0 for t in totals) <= 1
