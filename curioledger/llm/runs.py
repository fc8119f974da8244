"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. At
the dyadic scale B the words are cut into aligned blocks of B; whatever run has a period from B to
2B - 1 holds a block that occurs again one period later. The sum of squared differences between a
block and every window that starts B to 2B - 1 words after it is a convolution, computed with an
exact integer transform (NTT) modulo a prime: where it is zero, block and window agree. Distances
found so are seeds. Seeds one block apart with the same distance make a chain, the ends of a chain are moved
outwards by bisection over prefix hashes, and what is long enough is compared word by word at last.

A difference that is a multiple of the prime is no agreement; the hashes turn such seeds away, and
the comparison at the end holds for both. Many short texts share one array, parted by words of their
own; a long text has one for itself. Work is n log^2 n for any text, also one of a single word.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORDS = 24
LEAST_PERIODS = 3
FIRST_BLOCK = 8
SHARED_WORDS = 131_072
CHUNK = 131_072

# 15 * 2 ** 27 + 1 and a primitive root of it, for transforms of up to 2 ** 27 words (fixed values).
PRIME, ROOT, MOST_BITS = 2_013_265_921, 31, 27
_P = np.uint64(PRIME)
_HASH_PRIMES = (2_147_483_647, 2_147_483_629)

FOUND = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo a prime below 2 ** 31, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base % prime
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step) % np.uint64(prime)
        done, step = done + take, step * step % prime
    return out[:n]


_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _roots(n: int, back: bool) -> np.ndarray:
    if (n, back) not in _ROOTS:
        root = pow(ROOT, (PRIME - 1) // n, PRIME)
        _ROOTS[n, back] = _powers(pow(root, -1, PRIME) if back else root, max(n // 2, 1), PRIME)
    return _ROOTS[n, back]


def _forward(x: np.ndarray) -> np.ndarray:
    """Transform along the first axis, in place; the result is in bit-reversed order."""
    n = len(x)
    half = n // 2
    while half:
        parts = x.reshape(n // (2 * half), 2, half, -1)
        a, b = parts[:, 0], parts[:, 1]
        turned = (a + _P - b) * _roots(2 * half, False)[:, None]
        total = a + b
        parts[:, 0] = np.minimum(total, total - _P)
        parts[:, 1] = _mod(turned)
        half //= 2
    return x


def _back(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`_forward` times its length."""
    n = len(x)
    half = 1
    while half < n:
        parts = x.reshape(n // (2 * half), 2, half, -1)
        b = _mod(parts[:, 1] * _roots(2 * half, True)[:, None])
        a = parts[:, 0].copy()
        total, less = a + b, a + _P - b
        parts[:, 0] = np.minimum(total, total - _P)
        parts[:, 1] = np.minimum(less, less - _P)
        half *= 2
    return x


def agreements(ids: np.ndarray, starts: np.ndarray, block: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, distance)`` where a block's squared differences from a later window sum to zero.

    Distances go from ``nearest`` to ``2 * block - 1``. Every window asked for lies inside ``ids``
    or beyond its end, where no word agrees.
    """
    offsets = 2 * block - nearest
    width = offsets + block - 1
    n = 1 << (width - 1).bit_length()
    if n.bit_length() - 1 > MOST_BITS:
        raise ValueError(f"a block of {block} words is beyond the transform")
    # Beyond the end stand words that occur nowhere else.
    beyond = np.arange(len(ids), len(ids) + width + block, dtype=np.uint64)
    words = np.concatenate([ids.astype(np.uint64), beyond + (ids.max(initial=0).astype(np.uint64) + np.uint64(1))])
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod(words * words))])
    scale = np.uint64(pow(n, -1, PRIME))
    found_starts, found_distances = [], []
    rows = max(1, CHUNK // n)
    for at in range(0, len(starts), rows):
        chunk = starts[at : at + rows]
        pattern = np.zeros((n, len(chunk)), np.uint64)
        # The block backwards, so that the product of transforms correlates instead of convolving.
        pattern[-np.arange(block) % n] = words[chunk[None, :] + np.arange(block)[:, None]]
        window = np.zeros((n, len(chunk)), np.uint64)
        window[:width] = words[chunk[None, :] + nearest + np.arange(width)[:, None]]
        product = _mod(_forward(pattern) * _forward(window))
        cross = _mod(_back(product)[:offsets] * scale)
        own = _mod(squares[chunk + block] - squares[chunk])
        first = chunk[None, :] + nearest + np.arange(offsets)[:, None]
        other = _mod(squares[first + block] - squares[first])
        apart = _mod(own[None, :] + other + np.uint64(2) * (_P - cross))
        distance, column = np.nonzero(apart == 0)
        found_starts.append(chunk[column])
        found_distances.append(distance + nearest)
    if not found_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_starts), np.concatenate(found_distances)


class _Hashes:
    """Prefix hashes that tell whether two stretches agree; unequal ones pass with chance 2 ** -60."""

    def __init__(self, ids: np.ndarray, seed: int):
        drawn = np.random.default_rng(seed)
        self.parts = []
        for prime in _HASH_PRIMES:
            p = np.uint64(prime)
            base, factor = (int(x) for x in drawn.integers(1 << 20, prime - 1, 2))
            powers = _powers(base, len(ids) + 1, prime)
            marks = (ids.astype(np.uint64) % p * np.uint64(factor) + np.uint64(factor >> 3)) % p
            # Sums of fewer than 2 ** 32 residues stay below 2 ** 63.
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks * powers[:-1] % p)])
            self.parts.append((p, powers, sums % p))

    def same(self, a: np.ndarray, length: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Whether the words from ``a`` on agree with those ``distance`` later, for ``length``."""
        out = np.ones(len(a), bool)
        for p, powers, sums in self.parts:
            left = (sums[a + length] + p - sums[a]) % p * powers[distance] % p
            right = (sums[a + length + distance] + p - sums[a + distance]) % p
            out &= left == right
        return out


def _reach(hashes: _Hashes, start: np.ndarray, distance: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words beyond ``start``, or before it, still agree; at most ``room``, by bisection."""
    low, high = np.zeros(len(start), np.int64), room.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = hashes.same(start - middle if back else start, middle, distance)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _at_scale(ids, ends, hashes, block: int, least_words: int, periods: int) -> np.ndarray:
    """``(start, length, distance)`` of stretches with a period of this scale, ids in texts that end at ``ends``."""
    nearest = 1 if block == FIRST_BLOCK else block
    blocks = np.arange(0, len(ids) - block, block)
    # A block serves if its text is long enough and holds the nearest window that it is compared to.
    text = np.searchsorted(ends, blocks, side="right")
    enough = np.diff(ends, prepend=0) > max(least_words, periods * nearest)
    blocks = blocks[enough[text] & (blocks + block + nearest <= ends[text])]
    start, distance = agreements(ids, blocks, block, nearest)
    inside = start + block + distance <= ends[np.searchsorted(ends, start, side="right")]
    start, distance = start[inside], distance[inside]
    good = hashes.same(start, np.full(len(start), block), distance)
    start, distance = start[good], distance[good]
    order = np.lexsort((start, distance))
    start, distance = start[order], distance[order]
    cut = np.ones(len(start), bool)
    cut[1:] = (distance[1:] != distance[:-1]) | (start[1:] != start[:-1] + block)
    first, stop = start[cut], start[np.append(cut[1:], True)[: len(start)]] + block
    distance = distance[cut]
    # A chain's neighbours do not agree as whole blocks, so less than a block is left on either side;
    # at a text's borders there may be more, which are the blocks that did not serve.
    room = np.minimum(first, np.full(len(first), 2 * block))
    low = first - _reach(hashes, first, distance, room, True)
    room = np.minimum(len(ids) - stop - distance, 2 * block)
    high = stop + _reach(hashes, stop, distance, room, False) + distance
    length = high - low
    kept = length >= np.maximum(least_words, periods * distance)
    return np.stack([low[kept], length[kept], distance[kept]], axis=1)


def _all_runs(ids: np.ndarray, ends: np.ndarray, least_words: int, periods: int, seed: int = 11) -> np.ndarray:
    """Runs ``(start, length, period)`` over one array of texts, by start, then period."""
    hashes = _Hashes(ids, seed)
    longest = int(np.diff(ends, prepend=0).max(initial=0))
    found, block = [np.zeros((0, 3), np.int64)], FIRST_BLOCK
    while longest >= least_words and (block == FIRST_BLOCK or periods * block <= longest):
        found.append(_at_scale(ids, ends, hashes, block, least_words, periods))
        block *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    # Of the periods of one stretch the smallest counts; the others are its multiples.
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    for start, length, period in runs:
        if not np.array_equal(ids[start : start + length - period], ids[start + period : start + length]):
            return _all_runs(ids, ends, least_words, periods, seed + 1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _grouped(texts: list, shared_words: int):
    """Texts as words, in groups of at least ``shared_words`` words as far as they go."""
    group, size = [], 0
    for text in texts:
        group.append((text or b"").split())
        size += len(group[-1])
        if size >= shared_words:
            yield group
            group, size = [], 0
    if group:
        yield group


def runs_of(
    texts: list,
    least_words: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
    shared_words: int = SHARED_WORDS,
) -> list[tuple[np.ndarray, list[bytes]]]:
    """Runs of every UTF-8 text and its words."""
    if periods < 3 or least_words < 3 * FIRST_BLOCK:
        raise ValueError("block seeds need three periods and three first blocks")
    out = []
    for group in _grouped(texts, shared_words):
        # Parting words are numbered from 0, the others behind them; each occurs once.
        number = defaultdict(count(len(group)).__next__)
        parts, ends, at = [], [], 0
        for k, words in enumerate(group):
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            parts.append(np.array([k]))
            at += len(words)
            ends.append(at + k)
        ids = np.concatenate(parts)
        # A text ends at its parting word, which belongs to none.
        found = _all_runs(ids, np.array(ends) + 1, least_words, periods)
        starts = np.array([0, *(e + 1 for e in ends[:-1])], np.int64)
        owner = np.searchsorted(starts, found[:, 0], side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(group) + 1))
        for k, words in enumerate(group):
            own = found[cuts[k] : cuts[k + 1]].copy()
            own[:, 0] -= starts[k]
            out.append((own, words))
    return out


def _collapsed(runs: np.ndarray, words: list[bytes]) -> bytes:
    """The words that are in no run, or in the first period of each run that holds them."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def periodic_runs(
    docs: DataFrame, least_words: int = LEAST_WORDS, periods: int = LEAST_PERIODS, found: str = "found"
) -> DataFrame:
    """``docs``, all columns, and a struct ``found(runs, collapsed)`` for the column ``text``.

    ``runs`` has ``start, length, period`` of every run of at least ``least_words`` words and
    ``periods`` periods, by start, then period; ``collapsed`` is the text without what a run holds
    after its first period, words joined by one space. Words are what is between the characters
    space, tab, line feed, vertical tab, form feed and carriage return. A null or empty text has no
    run and collapses to the empty text. Very long texts are searched whole. Repeated rows are
    documents of their own; no other column is read, so nulls there do not matter; an empty table
    gives no rows. ``found`` replaces a column of that name.
    """

    rest = docs.drop(found)
    schema = T.StructType([*rest.schema.fields, T.StructField(found, T.StructType.fromDDL(FOUND))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = runs_of(batch["text"].cast(pa.binary()).to_pylist(), least_words, periods)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *(r for r, _ in rows)])
            sizes = np.cumsum([0, *(len(r) for r, _ in rows)])
            fields = [pa.array(flat[:, k]) for k in range(3)]
            each = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)
            texts = pa.array([_collapsed(r, w) for r, w in rows], pa.binary()).cast(pa.string())
            one = pa.StructArray.from_arrays([runs, texts], ["runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([*batch.columns, one], [*batch.schema.names, found])

    return rest.mapInArrow(search, schema)


def _planted(doc_id: Column, text: Column) -> Column:
    """The text with the repetition that the query's contract gives every tenth document."""
    mark = F.crc32(doc_id.cast("string").cast("binary"))
    turn = F.floor(mark / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = turn % n
        p = 1 + F.floor((n - a) / (3 + turn % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        origin = F.transform(places, lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(origin, lambda i: F.get(words, i)), " ")

    some = (mark % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    # As a variable of the outer function the words are cut once, not for every word.
    return F.when(some, F.transform(F.array(words), repeated)[0]).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of op11 for every row of ``docs(doc_id, text)``, after its planted repetition.

    A null doc_id plants nothing; otherwise as :func:`periodic_runs`. Other columns are not read.
    """
    planted = docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    searched = periodic_runs(planted)
    runs = F.col("found.runs")

    def higher(best: Column, run: Column) -> Column:
        # Exponents are compared as fractions; a later run wins only if its own is greater.
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform(
        runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    )
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    digests = searched.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.aggregate(runs, none, higher).alias("best"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return digests.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
