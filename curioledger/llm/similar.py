"""Near duplicates by the similarity of their word shingles.

The similarity of two texts is the Jaccard index of their sets of shingles. Equal sets are one node.
Nodes meet by their SimHash first: those whose fingerprints connect (``simhash``, over these shingles)
are compared with the first of their group. What fingerprints leave apart, as few of 64 bits cannot
tell a similarity near 0.8, meets under bands of minima (MinHash). No link rests on either alone:
the sets are intersected. ``BANDS`` bands of ``BAND_MINIMA`` minima let a pair of similarity s miss all of them
with chance ``(1 - s ** BAND_MINIMA) ** BANDS``: 3.2 in a million at 0.8, less above.

The nodes of a band meet in the tasks of its key, and what comes out of a task is a tree, not its
pairs: nodes that are already connected are not compared. Bands are taken in rounds, and a round
knows what the ones before have connected. In each, a bitmap of 1,024 parities per node bounds the
difference of two sets from below; nodes that by it are unlike all others of their key go no
further, so sets travel for the others only. Within a task the nodes with most possible partners
come first: that is the text which others were copied from, and after it little is left to compare.
A key with many or long sets is cut into chunks whose pairs of chunks are tasks of their own.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .components import connected_components
from .joins import spread_join
from .simhash import linked_fingerprints, majority

SEED = 42
SHINGLE_WORDS = 5
LEAST = 0.8
BANDS = 24
BAND_MINIMA = 4
MARK_WORDS = 16
BLOCK_ROWS = 8192
BLOCK_SHINGLES = 4_000_000
CHUNK = 4096

# The bands of each round: what the first one connects is not compared again in the others.
ROUNDS = ((0, 1), (1, 4), (4, BANDS))

_drawn = np.random.default_rng(SEED)
_FACTORS = _drawn.integers(0, 1 << 64, BANDS * BAND_MINIMA, np.uint64) | np.uint64(1)
_TERMS = _drawn.integers(0, 1 << 64, BANDS * BAND_MINIMA, np.uint64)

SIGN = "node long, size long, bands array<long>, mark array<long>, fp long"


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a UTF-8 text, sorted; a short text is one shingle."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1]
    spans = zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64))


def _sign(hashes: np.ndarray) -> tuple[int, int, list[int], list[int], int]:
    """Node, size, bands, mark and fingerprint of a set; an empty set has no band."""
    node = np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0]
    if not len(hashes):
        return int(node), 0, [], [0] * MARK_WORDS, 0
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        turned = hashes[at : at + CHUNK, None] * _FACTORS + _TERMS
        least = np.minimum(least, turned.min(axis=0))
    bands = [
        xxhash.xxh64_intdigest(least[BAND_MINIMA * k : BAND_MINIMA * (k + 1)].tobytes(), k) for k in range(BANDS)
    ]
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % (64 * MARK_WORDS), minlength=64 * MARK_WORDS) & 1
    mark = np.packbits(odd.astype(np.uint8)).view(np.int64)
    fp = majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))
    return int(node), len(hashes), np.array(bands, np.uint64).view(np.int64).tolist(), mark.tolist(), fp


def _signed(words: int):
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [_sign(shingles(t, words)) for t in texts]
        return pd.DataFrame(rows, columns=["node", "size", "bands", "mark", "fp"])

    return F.pandas_udf(run, SIGN)


def _sets(words: int):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts], dtype=object)

    return F.pandas_udf(run, "binary")


def _similar(least: float):
    def run(ones: pd.Series, others: pd.Series) -> pd.Series:
        found = []
        for one, other in zip(ones, others, strict=True):
            a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            found.append(shared / (len(a) + len(b) - shared) >= least)
        return pd.Series(found, dtype=bool)

    return F.pandas_udf(run, "boolean")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``(u, v)``: every node with the first one of those its fingerprint is connected to."""
    held = nodes.filter(F.col("size") > 0).select("node", "fp")
    groups = spread_join(held, linked_fingerprints(held.select("fp").distinct()), "fp", "left")
    groups = settle(groups.select("node", F.coalesce("root", "fp").alias("group")))
    first = groups.groupBy("group").agg(F.min("node").alias("v"), F.count("*").alias("rows"))
    first = first.filter(F.col("rows") > 1).select("group", "v")
    pairs = spread_join(groups, first, "group").filter(F.col("node") != F.col("v"))
    return settle(pairs.select(F.col("node").alias("u"), "v"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(u, v)`` whose sets are similar."""
    full = spread_join(pairs, sets.select(F.col("node").alias("u"), F.col("set").alias("one")), "u")
    full = spread_join(full, sets.select(F.col("node").alias("v"), F.col("set").alias("other")), "v")
    return settle(full.filter(_similar(least)("one", "other")).select("u", "v"))


def _with_roots(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """``rooted(node, root)`` after edges between roots."""
    tops = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = spread_join(rooted, tops, "root", "left")
    return settle(rooted.select("node", F.coalesce("top", "root").alias("root")))


def _dealt(keyed: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """``keyed(key, node, root, size, ..)`` with its tasks ``(key, a, b)``, shuffled and sorted by them.

    Chunk c of a key that is too large for one task meets every other chunk in a task of its own.
    """
    parts = F.greatest(F.count("*") / block_rows, F.sum("size") / block_shingles)
    many = keyed.groupBy("key").agg(F.ceil(parts).cast("int").alias("chunks"))
    sized = spread_join(keyed, many.filter(F.col("chunks") > 1), "key", "left")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != chunk)
    meets = F.transform(
        others, lambda c: F.struct(F.least(c, chunk).alias("a"), F.greatest(c, chunk).alias("b"))
    )
    tasks = F.when(F.col("chunks") > 1, meets).otherwise(whole)
    rest = [c for c in keyed.columns if c != "key"]
    dealt = sized.select("key", *rest, F.explode(tasks).alias("t")).select("key", "t.a", "t.b", *rest)
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def _by_task(of_task):
    """mapInPandas over rows sorted by task: ``of_task`` gets the rows of one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            task = batch[["key", "a", "b"]].to_numpy()
            cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                if held and tuple(task[at]) != last:
                    yield of_task(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch.iloc[at:end])
                last = tuple(task[at])
        if held:
            yield of_task(pd.concat(held, ignore_index=True))

    return run


class _Marks:
    """Bitmaps of a task's nodes, and what they rule out."""

    def __init__(self, rows: pd.DataFrame, least: float):
        self.share = (1 - least) / (1 + least)
        self.sizes = rows["size"].to_numpy()
        self.bits = np.stack(rows["mark"].to_list()).astype(np.int64).view(np.uint64)

    def possible(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose difference from row i may be small enough."""
        apart = np.bitwise_count(self.bits[others] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        return others[apart <= np.ceil((self.sizes[others] + self.sizes[i]) * self.share + 1e-6)]


def _with_partners(least: float):
    """Per task the nodes that may link to one of another root, and to how many."""

    def of_task(rows: pd.DataFrame) -> pd.DataFrame:
        roots, marks = rows["root"].to_numpy(), _Marks(rows, least)
        near = np.zeros(len(rows), np.int64)
        for i in range(len(rows) - 1):
            others = marks.possible(i, np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1)
            near[i] += len(others)
            near[others] += 1
        found = rows[["key", "a", "b", "node", "root", "size", "mark"]].assign(near=near)
        return found[near > 0]

    return _by_task(of_task)


def _tree(least: float):
    """Per task edges ``(u, v)`` between roots that connect whatever is similar."""

    def of_task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["near", "node"], ascending=[False, True], ignore_index=True)
        marks = _Marks(rows, least)
        given, group = np.unique(rows["root"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
        edges = []
        for i in range(len(rows) - 1):
            others = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            others = marks.possible(i, others)
            if not len(others):
                continue
            flat = np.concatenate([sets[j] for j in others])
            sizes = marks.sizes[others]
            at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            ends = np.cumsum(sizes)
            held = np.concatenate([[0], np.cumsum(sets[i][at] == flat)])
            shared = held[ends] - held[ends - sizes]
            similar = shared / (sizes + len(sets[i]) - shared) >= least
            for j in others[similar].tolist():
                if group[j] != group[i]:
                    edges.append((given[group[i]], given[group[j]]))
                    group[group == group[j]] = group[i]
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return _by_task(of_task)


def _round_links(
    rooted: DataFrame, facts: DataFrame, sets: DataFrame, least: float, block_rows: int, block_shingles: int
) -> DataFrame:
    """Edges between roots that the bands of ``rooted(key, node, root)`` add."""
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    apart = apart.filter(F.col("low") < F.col("high")).select("key")
    left = settle(spread_join(spread_join(rooted, apart, "key", "left_semi"), facts, "node"))
    kind = "key long, a int, b int, node long, root long, size long, mark array<long>, near long"
    near = settle(_dealt(left, block_rows, block_shingles).mapInPandas(_with_partners(least), kind))
    full = spread_join(near, sets, "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return settle(full.mapInPandas(_tree(least), "u long, v long").distinct())


def similar_groups(
    signed: DataFrame,
    texts: DataFrame,
    words: int,
    least: float,
    block_rows: int = BLOCK_ROWS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``(node, root)`` of the nodes of ``signed`` that meet another by fingerprint or band.

    ``signed`` has ``doc_id, hash, sign``; ``texts`` has ``doc_id, hash, text``, of which one text is
    read for each such node. Roots are nodes; all nodes that are connected by links have one root.
    """
    nodes = signed.select("sign.*").groupBy("node")
    nodes = settle(nodes.agg(*[F.first(c).alias(c) for c in ("size", "bands", "mark", "fp")]))
    pairs = _fingerprint_pairs(nodes)
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1).select("key")
    keyed = settle(spread_join(keyed, shared, "key", "left_semi"))
    met = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    wanted = settle(keyed.select("node").union(met).distinct())

    one = F.min(F.struct("doc_id", "hash")).alias("one")
    held = signed.select(F.col("sign.node").alias("node"), "doc_id", "hash")
    held = spread_join(held, wanted, "node", "left_semi").groupBy("node").agg(one)
    held = held.select("node", F.col("one.doc_id").alias("first_id"), F.col("one.hash").alias("first_hash"))
    same = (texts["doc_id"] == held["first_id"]) & (texts["hash"] == held["first_hash"])
    chosen = texts.join(held, same).select("node", _sets(words)(F.col("text").cast("binary")).alias("set"))
    # Repeated rows of one id and text give a node twice.
    sets = settle(chosen).dropDuplicates(["node"])

    facts = settle(spread_join(nodes.select("node", "size", "mark"), wanted, "node", "left_semi"))
    rooted = _with_roots(wanted.withColumn("root", F.col("node")), _verified(pairs, sets, least))
    for low, high in ROUNDS:
        band = keyed.filter((F.col("band") >= low) & (F.col("band") < high)).select("key", "node")
        rows = settle(spread_join(band, rooted, "node"))
        edges = _round_links(rows, facts, sets, least, block_rows, block_shingles)
        rooted = _with_roots(rooted, edges)
    return rooted


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one row of each group of similar texts.

    Texts are similar when at least ``least`` of the shingles of ``words`` words that either has are
    in both; groups are closed over that. Null texts and texts without a word are one group. The row
    that stays has the smallest doc_id of its group; of rows that repeat that id within it, any one
    stays. Rows without a doc_id cannot be told apart by it and stay. An empty table stays empty, very
    long texts are compared whole, and no other column is read.
    """
    texts = docs.filter(F.col("doc_id").isNotNull())
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    signed = settle(texts.select("doc_id", "hash", _signed(words)(F.col("text").cast("binary")).alias("sign")))
    groups = similar_groups(signed, texts, words, least)

    ids = signed.select("doc_id", "hash", F.col("sign.node").alias("node"))
    ids = spread_join(ids, groups, "node", "left")
    ids = ids.select("doc_id", "hash", F.coalesce("root", "node").alias("root"))
    rows = settle(ids.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("rows")))
    stay = rows.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("stay"))
    rows = spread_join(rows, stay, "root")
    stays = (F.col("doc_id") == F.col("stay.doc_id")) & (F.col("hash") == F.col("stay.hash"))
    marked = settle(rows.select(F.col("doc_id").alias("own"), F.col("hash").alias("own_hash"), "rows", stays.alias("stays")))

    def of(keys: DataFrame):
        hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
        return (docs["doc_id"] == keys["own"]) & (hashed == keys["own_hash"])

    # All that is not dropped stays in place; only rows that repeat id and text are gathered.
    repeated = marked.filter(F.col("stays") & (F.col("rows") > 1)).select("own", "own_hash")
    dropped = marked.filter(~F.col("stays") | (F.col("rows") > 1)).select("own", "own_hash")
    kept = docs.join(dropped, of(dropped), "left_anti")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, of(repeated), "left_semi")
    everything = F.struct(*[docs[c] for c in docs.columns])
    again = again.select(F.struct(F.col("doc_id"), F.xxhash64("text")).alias("key"), everything.alias("row"))
    return kept.union(again.groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
