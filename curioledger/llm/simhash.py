"""Near duplicates by SimHash, compared in bit-sliced blocks.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints link
when at most ``radius`` bits differ. Distinct fingerprints only are compared: the 64 bits are cut
into ``radius + 2`` blocks, so two linked fingerprints agree in at least two whole blocks, and every
pair of blocks is a key under which they meet. The rows of a key are compared in vertical form: one
bit plane per fingerprint bit, 64 fingerprints to a machine word, differences counted by carry-save
adders in the words, and a word is given up once all its lanes are beyond the radius. Lanes that
are already connected are not compared again, so a group of copies costs a tree and not its pairs.

A key with more than ``block_rows`` fingerprints is cut into chunks whose pairs go to separate tasks.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .components import connected_components
from .joins import dealt_by_key, spread_join

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
BLOCK_ROWS = 8192
BATCH_ROWS = 65_536


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; zero for null and for texts without a word."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        digests = xxhash.xxh64_digest(b" ".join(found), SEED)
    else:
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1]
        spans = zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(line[a:b], SEED) for a, b in spans])
    return majority(np.frombuffer(digests, np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that over half of the hashes have, rows of eight bytes each."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BATCH_ROWS):
        counts += np.unpackbits(hashes[at : at + BATCH_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    marked = F.pandas_udf(_fingerprints, "long")
    return docs.select("doc_id", marked(F.col("text").cast("binary")).alias("fp"))


def _block_bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _keys(blocks: int):
    """One key per pair of blocks: the number of the pair above the bits of both."""
    bounds = _block_bounds(blocks)

    def bits(at: int, end: int):
        return F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << (end - at)) - 1))

    keys = []
    for number, (a, b) in enumerate(combinations(bounds, 2)):
        low = bits(*b)
        high = F.shiftleft(bits(*a), b[1] - b[0])
        keys.append(high.bitwiseOR(low).bitwiseOR(F.lit(number << 48)))
    return F.array(*keys)


def _beyond(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose three-bit count is above the radius."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for place in (2, 1, 0):
        if radius >> place & 1:
            equal &= count[place]
        else:
            above |= equal & count[place]
            equal &= ~count[place]
    return above


def linked(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Tree edges ``(i, j)`` that connect whatever links inside each run of equal ``group``.

    Rows are lanes of 64-bit words, one array of words per fingerprint bit. At shift s lane i meets
    lane i + s, so all groups of a block advance together.
    """
    if not 0 <= radius <= 6:
        raise ValueError("the radius fits the three-bit counters from 0 to 6")
    n = len(fps)
    words = n // 64 + 1
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n) if n else np.zeros(0, np.int64)
    end = ends[np.searchsorted(ends, np.arange(n), side="right")] if n else ends
    widest = int((end - np.arange(n)).max()) if n else 0
    bits = np.zeros((64, words * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).T
    planes = np.zeros((64, words + widest // 64 + 2), np.uint64)
    planes[:, :words] = np.packbits(bits, axis=1, bitorder="little").view("<u8")

    parent = np.arange(n)
    pairs: list[tuple[int, int]] = []
    live = np.arange(n)
    for shift in range(1, widest):
        live = live[live + shift < end[live]]
        apart = live[parent[live] != parent[live + shift]]
        if not len(apart):
            continue
        wanted = np.zeros(words * 64, np.uint8)
        wanted[apart] = 1
        wanted = np.packbits(wanted, bitorder="little").view("<u8")
        chosen = np.flatnonzero(wanted)
        wanted = wanted[chosen]
        skip, turn = divmod(shift, 64)
        count = [np.zeros(len(chosen), np.uint64) for _ in range(3)]
        dead = ~wanted
        for bit in range(64):
            plane = planes[bit]
            other = plane[chosen + skip]
            if turn:
                other = (other >> np.uint64(turn)) | (plane[chosen + skip + 1] << np.uint64(64 - turn))
            carry = plane[chosen] ^ other
            for place in range(3):
                count[place], carry = count[place] ^ carry, count[place] & carry
            dead |= carry
            if bit % 4 == 3:
                dead |= _beyond(count, radius)
                kept = ~dead != 0
                if not kept.any():
                    break
                if 2 * kept.sum() < len(kept):
                    chosen, dead = chosen[kept], dead[kept]
                    count = [c[kept] for c in count]
        else:
            lanes = np.unpackbits((~dead).view(np.uint8), bitorder="little").reshape(-1, 64)
            word, bit = np.nonzero(lanes)
            for i in (chosen[word] * 64 + bit).tolist():
                a, b = i, i + shift
                while parent[a] != a:
                    a = int(parent[a])
                while parent[b] != b:
                    b = int(parent[b])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    pairs.append((i, i + shift))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return pairs


def _linker(radius: int):
    """mapInPandas over rows sorted by task: blocks end where a task ends."""

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        task = rows[["key", "a", "b"]].to_numpy()
        group = np.zeros(len(rows), np.int64)
        group[1:] = np.cumsum((task[1:] != task[:-1]).any(axis=1))
        shared = np.bincount(group)[group] > 1
        group, kept = group[shared], rows[shared]
        nodes = kept["node"].to_numpy()
        pairs = linked(group, kept["fp"].to_numpy().view(np.uint64), radius)
        u, v = np.array(pairs, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"u": nodes[u], "v": nodes[v]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < BATCH_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            task = rows[["key", "a", "b"]].to_numpy()
            cuts = np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1
            cut = int(cuts[-1]) if len(cuts) else 0
            if cut:
                yield edges(rows.iloc[:cut])
            held = [rows.iloc[cut:]]
            size = len(held[0])
        if held:
            yield edges(pd.concat(held, ignore_index=True))

    return run


def links(nodes: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(u, v)`` that connect all nodes ``(node, fp)`` whose distinct fingerprints link."""
    keyed = nodes.select("node", "fp", F.explode(_keys(radius + 2)).alias("key"))
    dealt = dealt_by_key(keyed, "fp", block_rows)
    return dealt.mapInPandas(_linker(radius), "u long, v long")


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` of the distinct ``fps(fp)`` that link to another; root is the smallest reachable."""
    labels = connected_components(links(fps.select(F.col("fp").alias("node"), "fp"), radius))
    return labels.withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links, itself included; links are between
    fingerprints, so a doc_id held by unlike texts joins none of them. Null and empty
    texts have fingerprint zero and link like any other; repeated rows each come back, in one
    component; a null doc_id is kept and names no component while a known one is there. An empty
    table gives no rows. Other columns are not read.
    """
    marked = settle(fingerprints(docs))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = spread_join(nodes, linked_fingerprints(nodes, radius), "fp", "left")
    rooted = settle(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = spread_join(rooted.select("fp", "root"), least, "root").select("fp", "component_id")
    named = spread_join(marked, roots, "fp", "left")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return named.select("doc_id", digits.alias("fingerprint"), "component_id")
