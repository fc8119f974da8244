"""Nearest vectors by a permutation index.

A vector is represented by its ``places`` nearest pivots, nearest first. Pivots are a bounded sample
of the vectors. The index holds, per shard of vectors, one inverted file per pivot: at which place
each row has it, if any. A query walks the files of its own pivots only; what they hold adds up
to the footrule distance, the sum of the differences of a pivot's places, a pivot that one side
lacks standing behind its last. Rows up to a query's footrule cut are compared in double precision on
the original vectors, by quick products first; whatever these leave in doubt is summed row by row.

The cut is the same for all shards: the distance within which a share of a bounded sample of all
vectors lies, so its number of rows grows with the table and has no cap. Equal vectors are one entry
with the smallest ids that hold it. Every vector is in the index. Queries go over it in bounded
blocks, each broadcast to the tasks; no rows are shuffled but a shard's best for every query, and of
those only what reaches the score that the query has already found in a first slice of the index.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import settle
from .joins import spread_join

NEAREST = 20
PIVOTS = 128
PLACES = 64
PIVOT_COSINE = 0.7
SAMPLE_ROWS = 4096
SHARE = 0.12
LEAST_ROWS = 2048
SHARD_ROWS = 8192
FIRST_SLICES = 64
QUERY_BLOCK = 16_384
# Beyond these lengths, or their inverses, squares and products may leave the range of doubles.
LEAST_LENGTH = 1e-140

_FOUND = "query long, vec_id long, score double"


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """``(vec_id, vec)`` of the rows that take part: an id, finite components, one of them not zero."""
    vec = F.transform(vector, lambda x: x.cast("double"))
    fit = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(F.col("vec"), lambda x: x != 0)
    named = rows.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    return named.filter(F.coalesce(fit & some, F.lit(False)))


def _packed(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * vectors.itemsize
    ends = np.arange(len(vectors) + 1, dtype=np.int32) * width
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(vectors))]
    return pa.Array.from_buffers(pa.binary(), len(vectors), buffers)


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _vectors(column: pa.Array) -> np.ndarray:
    """An array column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots by angle, nearest first; equal ones by number."""
    near = vectors / np.abs(vectors).max(axis=1, keepdims=True) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :places].astype(np.uint16)


def chosen_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Directions of sampled vectors, none close to an earlier one while there are others.

    Many pivots in one dense group would move through the permutations together and drown the rest.
    """
    scaled = sample / np.abs(sample).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    apart, close = np.zeros((0, unit.shape[1])), []
    for vector in unit:
        if len(apart) == pivots:
            break
        if (apart @ vector < PIVOT_COSINE).all():
            apart = np.vstack([apart, vector])
        else:
            close.append(vector)
    return np.vstack([apart, *close[: pivots - len(apart)]])


class InvertedFiles:
    """The pivots' files of one shard: how far before the last place each row has the pivot.

    A file has one small number per row, 0 for rows that lack the pivot. With half of the pivots in
    every prefix that is shorter than lists of rows and places, and one pass over it takes no lookups.
    """

    def __init__(self, prefixes: np.ndarray, pivots: int):
        self.rows_in, self.places = prefixes.shape
        self.kind = np.uint16 if self.places * (self.places + 1) < 1 << 16 else np.uint32
        self.files = np.zeros((pivots, self.rows_in), self.kind)
        own = np.arange(self.rows_in)
        for place in range(self.places):
            self.files[prefixes[:, place], own] = self.places - place

    def footrule(self, prefix: np.ndarray) -> np.ndarray:
        """Distance of every row to a query's prefix.

        Without a shared pivot it is twice 1 + .. + places. Of a shared one |a - b| is left instead of
        a + b, as both are counted from the end: the smaller of the two is taken off twice.
        """
        shared = np.zeros(self.rows_in, self.kind)
        own, one = np.empty_like(shared), np.empty_like(shared)
        for at, pivot in enumerate(prefix.tolist()):
            # Of two arrays the smaller is found several times faster than of an array and a number.
            own.fill(self.places - at)
            np.minimum(self.files[pivot], own, out=one)
            np.add(shared, one, out=shared)
        return self.places * (self.places + 1) - 2 * shared.astype(np.int32)


def _longest(vectors: np.ndarray) -> float:
    """Greatest length of a row; infinite where its square overflows."""
    with np.errstate(over="ignore"):
        return float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0)))


def _may_be_best(vectors: np.ndarray, vector: np.ndarray, most: int, longest: float) -> np.ndarray:
    """Places of all rows, none over ``longest``, that can be among the ``most`` best.

    Told by products rounded in any order, with room for the rounding.
    """
    length = _longest(vector[None])
    if len(vectors) <= 4 * most or not all(LEAST_LENGTH < x < 1 / LEAST_LENGTH for x in (longest, length)):
        return np.arange(len(vectors))
    rough = np.einsum("ij,j->i", vectors, vector)
    # Either rounding errs by less than this, for the row and for the one it is held against.
    slack = 4 * len(vector) * np.finfo(float).eps * longest * length
    return np.flatnonzero(rough >= np.partition(rough, len(rough) - most)[len(rough) - most] - slack)


def _by_rank(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best: highest score first, equal ones by id."""
    if len(ids) > 4 * most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def _searcher(block: dict, pivots: int, most: int, shard_rows: int) -> Callable:
    """mapInArrow over index rows ``(ids, vec, prefix)``: the best of each shard for every query."""

    def search(ids: list[list[int]], vectors: np.ndarray, prefixes: np.ndarray) -> pa.RecordBatch:
        files, longest = InvertedFiles(prefixes, pivots), _longest(vectors)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        flat = np.array([i for some in ids for i in some], np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for query, vector, prefix, cut, least in zip(*block.values(), strict=True):
            near = np.flatnonzero(files.footrule(prefix) <= cut)
            near = near[_may_be_best(vectors.take(near, axis=0), vector, most, longest)]
            # Each row is summed by itself, so equal vectors have equal scores in every shard.
            scores = (vectors[near] * vector).sum(axis=1)
            high = scores >= least
            near, scores = near[high], scores[high]
            count = sizes[near]
            place = np.repeat(firsts[near] - np.cumsum(count) + count, count) + np.arange(count.sum())
            own, scores = flat[place], np.repeat(scores, count)
            best = _by_rank(own, scores, most)
            found.append((np.full(len(best), query), own[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(at, shard_rows))
                if sum(b.num_rows for b in held) >= shard_rows:
                    yield of(held)
                    held = []
        if held:
            yield of(held)

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, vec, prefix = (rows[c].combine_chunks() for c in ("ids", "vec", "prefix"))
        return search(ids.to_pylist(), _unpacked(vec, "f8"), _unpacked(prefix, "u2"))

    return run


def _indexed(pivots: np.ndarray, places: int) -> Callable:
    """mapInArrow: rows with their vector packed and their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch["vec"])
            prefix = nearest_pivots(vectors, pivots, places)
            names = [n for n in batch.schema.names if n != "vec"]
            columns = [batch[n] for n in names] + [_packed(vectors), _packed(prefix)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "vec", "prefix"])

    return run


def _cut(sample: np.ndarray, pivots: int, share: float) -> Callable:
    """mapInArrow over queries: adds the footrule distance within which the share of the sample lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = InvertedFiles(sample, pivots)
        rank = min(len(sample), max(1, int(np.ceil(share * len(sample))))) - 1
        for batch in batches:
            if batch.num_rows:
                cuts = [int(np.partition(files.footrule(p), rank)[rank]) for p in _unpacked(batch["prefix"], "u2")]
                # When the sample is the whole table and all of it is wanted, every row is compared.
                cuts = [np.iinfo(np.int32).max if rank == len(sample) - 1 else c for c in cuts]
                columns = [*batch.columns, pa.array(cuts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cut"])

    return run


def _best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each query as one sorted array; ranks are cut before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    top = found.withColumn("place", rank).filter(F.col("place") <= most)
    return top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top"))


def nearest(
    rows: DataFrame,
    asked: Column,
    vector: str = "embedding",
    most: int = NEAREST,
    pivots: int = PIVOTS,
    places: int = PLACES,
    share: float = SHARE,
    query_block: int = QUERY_BLOCK,
    first_slices: int = FIRST_SLICES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``most`` nearest found of each row for which ``asked`` holds.

    ``rows`` has ``vec_id`` and ``vector``; ``asked`` is a condition on ``vec_id``. Nearness is the
    inner product in double precision, equal scores go by ``vec_id``. Rows take part if they have an
    id and a vector of finite components that are not all zero, as long as most of the table's
    vectors are (of equally frequent lengths the shorter). Rows of one id with equal vectors are one
    row; a row is never near to its own id. Fewer candidates than ``most`` all come back; a query
    without any, and an empty table, give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    fit = settle(usable(rows, vector))
    lengths = fit.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), "size").limit(1)
    fit = fit.join(F.broadcast(usual.select("size")), F.size("vec") == F.col("size")).select("vec_id", "vec")

    # Of equal vectors a result can hold the first ``most`` ids and the query's own.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    ids = fit.distinct().withColumn("place", place).filter(F.col("place") <= most + 1)
    entries = ids.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = entries.withColumn("mark", F.xxhash64("vec"))
    entries = settle(entries)
    n = entries.count()
    queries = fit.filter(asked).groupBy("vec").agg(F.min("vec_id").alias("query"))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # Both samples have a fixed number of rows: the pivots, and the vectors that set the cut.
    drawn = entries.orderBy("mark", F.col("ids")[0]).limit(max(pivots, SAMPLE_ROWS)).select("vec").collect()
    sample = np.array([r["vec"] for r in drawn])
    chosen = chosen_pivots(sample, pivots)
    places = min(places, max(1, len(chosen) // 2))
    near_sample = nearest_pivots(sample[:SAMPLE_ROWS], chosen, places)

    shards = max(1, -(-n // SHARD_ROWS))
    slices = first_slices if n > first_slices * SHARD_ROWS else 1
    index = entries.repartition(shards, "mark").mapInArrow(
        _indexed(chosen, places), "ids array<long>, mark long, vec binary, prefix binary"
    )
    index = index.withColumn("first", (F.pmod("mark", F.lit(slices)) == 0).cast("int")).drop("mark")
    index = settle(index)
    wanted = min(1.0, max(share, LEAST_ROWS / n))
    packed = queries.withColumn("mark", F.xxhash64("vec")).mapInArrow(
        _indexed(chosen, places), "query long, mark long, vec binary, prefix binary"
    )
    packed = packed.mapInArrow(
        _cut(near_sample, len(chosen), wanted), "query long, mark long, vec binary, prefix binary, cut int"
    )
    packed = settle(packed)
    asked_rows = packed.count()

    blocks = max(1, -(-asked_rows // query_block))
    parts = []
    for number in range(blocks):
        mine = packed.filter(F.pmod(F.xxhash64("mark"), F.lit(blocks)) == number)
        if slices == 1:
            parts.append(_searched(index, mine, None, len(chosen), most + 1))
            continue
        head = settle(_searched(index.filter("first = 1"), mine, None, len(chosen), most + 1))
        rest = _searched(index.filter("first = 0"), mine, head, len(chosen), most + 1)
        parts.append(head.union(rest))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(settle(part))
    best = settle(_best(found, most + 1))

    named = fit.filter(asked).distinct()
    named = settle(spread_join(named, queries, "vec").select("vec_id", "query"))
    named = spread_join(named.withColumnRenamed("vec_id", "query_id"), best, "query")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, most)
    each = named.select("query_id", F.posexplode(others).alias("at", "hit"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


def _searched(index: DataFrame, queries: DataFrame, head: DataFrame | None, pivots: int, most: int) -> DataFrame:
    """The best of every shard for a block of queries, which is bounded and goes to all tasks."""
    if head is not None:
        least = _best(head, most).filter(F.size("top") == most)
        least = least.select("query", F.col("top")[most - 1]["score"].alias("least"))
        queries = queries.join(least, "query", "left")
    else:
        queries = queries.withColumn("least", F.lit(None).cast("double"))
    rows = queries.collect()
    block = {
        "query": [r["query"] for r in rows],
        "vector": [np.frombuffer(r["vec"], "f8") for r in rows],
        "prefix": [np.frombuffer(r["prefix"], "u2") for r in rows],
        "cut": [r["cut"] for r in rows],
        "least": [-np.inf if r["least"] is None else r["least"] for r in rows],
    }
    if not rows:
        return index.sparkSession.createDataFrame([], _FOUND)
    return index.select("ids", "vec", "prefix").mapInArrow(_searcher(block, pivots, most, SHARD_ROWS), _FOUND)
