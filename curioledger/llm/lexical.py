"""Ranked lexical search over norm buckets of impact vectors.

A text is a vector with one impact per term, an item a vector of term weights; the score of a text
for an item is their inner product in whole numbers. Both are scaled by the square root of the
weights, which leaves the product as it is and takes length from common terms. Vectors are ordered
by length and cut into buckets. An item skips a bucket whose longest vector cannot reach the item's
threshold even in the item's own direction (Cauchy-Schwarz). Inside a bucket the product over the
item's heaviest terms is exact, and the rest of a vector is bounded by its remaining length; what
can still reach the threshold is rescored exactly in integers.

The threshold is the lowest score that an item's best texts have so far, first those of the longest
vectors of all, then also those of the task's earlier buckets. Bounds have a relative slack far above
rounding errors, and texts that just reach the threshold stay, so the result is that of scoring all.

Items go in blocks whose terms are bounded and sent to every task; texts are read once a block.
"""

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import settle

MOST = 20
BLOCK_TERMS = 200_000
BUCKET_ROWS = 1024
HEAD_SHARE = 0.02
HEAD_ROWS = 8192
FOCUS = 0.5
SLACK = 1e-9

# Letters, digits and all that is not ASCII make terms; only A-Z have a lower case here.
_LOWER = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included."""
    return (text or b"").translate(_LOWER).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(terms_of(t)) for t in batch["text"].cast(pa.binary()).to_pylist()]
        terms = [list(c) for c in counts]
        times = [list(c.values()) for c in counts]
        columns = [batch["item_id"], batch["item"], pa.array(terms, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "item", "terms", "times"])


def _bytes(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _postings(vocabulary: dict[bytes, int]) -> Callable:
    """mapInArrow over ``(doc_id, text)``: number of terms, and the asked terms that the text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, times = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                found = terms_of(text)
                sizes.append(len(found))
                known = np.array([k for k in map(vocabulary.get, found) if k is not None], np.int32)
                number, count = np.unique(known, return_counts=True)
                numbers.append(number)
                times.append(count.astype(np.int32))
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), _bytes(numbers), _bytes(times)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "numbers", "times"])

    return run


def _document_counts(size: int) -> Callable:
    """mapInArrow over ``numbers``: how many texts of the task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for number in batch["numbers"].to_pylist():
                held[np.frombuffer(number, np.int32)] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["number", "texts"])

    return run


def _impacts(weights: np.ndarray, documents: int, words: int) -> Callable:
    """mapInArrow: impacts in whole numbers, and the length of the scaled vector."""
    scale = np.sqrt(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            impacts, norms = [], []
            rows = zip(*(batch[c].to_pylist() for c in ("n", "numbers", "times")), strict=True)
            for n, number, times in rows:
                m = 75 + 25 * n * documents // words
                tf = np.frombuffer(times, np.int32).astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                scaled = impact * scale[np.frombuffer(number, np.int32)]
                impacts.append(impact)
                norms.append(float(np.sqrt(scaled @ scaled)))
            columns = [batch["doc_id"], batch["numbers"], _bytes(impacts), pa.array(norms, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "numbers", "impacts", "norm"])

    return run


class _Item:
    """An item's terms by falling scaled weight, and how many of them are in focus."""

    def __init__(self, item: int, numbers: np.ndarray, times: np.ndarray, weights: np.ndarray, least: int):
        weight = weights[numbers] * times
        scaled = weight / np.sqrt(np.maximum(weights[numbers], 1))
        order = np.argsort(-scaled, kind="stable")
        self.item, self.least = item, least
        self.numbers, self.weight = numbers[order], weight[order]
        square = scaled[order] ** 2
        self.norm = float(np.sqrt(square.sum()))
        left = np.sqrt(np.maximum(square.sum() - np.cumsum(square), 0))
        # In focus are the heaviest terms, up to the one that leaves half of the length.
        self.focus = int(np.argmax(left <= FOCUS * self.norm)) + 1
        self.rest = float(left[self.focus - 1])
        self.ids, self.scores = [], []


class _Bucket:
    """Vectors of like length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, scale: np.ndarray):
        numbers = [np.frombuffer(b, np.int32) for b in batch["numbers"].to_pylist()]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.ids = batch["doc_id"].to_pylist()
        self.norms = batch["norm"].to_numpy()
        self.longest = float(self.norms.max())
        self.firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.numbers = np.concatenate(numbers)
        self.impacts = np.frombuffer(b"".join(batch["impacts"].to_pylist()), np.int64)
        order = np.argsort(self.numbers, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.by_term = self.impacts[order]
        self.scaled = (self.impacts * scale[self.numbers])[order] ** 2
        self.terms, self.cuts = np.unique(self.numbers[order], return_index=True)
        self.cuts = np.append(self.cuts, len(order))

    def postings(self, number: int) -> slice:
        at = int(np.searchsorted(self.terms, number))
        found = at < len(self.terms) and self.terms[at] == number
        return slice(self.cuts[at], self.cuts[at + 1]) if found else slice(0, 0)

    def candidates(self, item: _Item) -> np.ndarray:
        """Rows that can still reach the item's threshold."""
        total = np.zeros(len(self.ids))
        square = self.norms**2
        for number, weight in zip(item.numbers[: item.focus], item.weight[: item.focus], strict=True):
            some = self.postings(number)
            total[self.rows[some]] += weight * self.by_term[some]
            square[self.rows[some]] -= self.scaled[some]
        # Rounding can leave a little of a length that is used up.
        rest = np.sqrt(np.maximum(square, 0) + SLACK * self.norms**2)
        return np.flatnonzero((total + item.rest * rest) * (1 + SLACK) >= item.least)

    def exact(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of rows, by the weights of all terms."""
        sizes = self.firsts[rows + 1] - self.firsts[rows]
        place = np.repeat(self.firsts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(weights[self.numbers[place]] * self.impacts[place])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def _searcher(items: list[tuple], weights: np.ndarray, most: int) -> Callable:
    """mapInArrow over vectors by falling length: every item's best of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.sqrt(weights.astype(np.float64))
        asked = [_Item(item, np.frombuffer(n, np.int32), np.frombuffer(t, np.int64), weights, least) for item, n, t, least in items]
        dense = np.zeros(len(weights), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET_ROWS):
                bucket = _Bucket(batch.slice(at, BUCKET_ROWS), scale)
                asked = [item for item in asked if _may_reach(item, bucket) or _done(item)]
                for item in asked:
                    if _may_reach(item, bucket):
                        _search(item, bucket, dense, most)
        found = [(item.item, i, s) for item in asked for i, s in zip(item.ids, item.scores, strict=True)]
        columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _may_reach(item: _Item, bucket: _Bucket) -> bool:
    """Whether the longest vector of the bucket reaches the threshold if it points where the item does."""
    return item.norm * bucket.longest * (1 + SLACK) >= item.least


def _done(item: _Item) -> bool:
    """Buckets only get shorter, so an item that skips one and has found nothing is left out."""
    return bool(item.ids)


def _search(item: _Item, bucket: _Bucket, dense: np.ndarray, most: int) -> None:
    rows = bucket.candidates(item)
    if not len(rows):
        return
    dense[item.numbers] = item.weight
    scores = bucket.exact(rows, dense)
    dense[item.numbers] = 0
    high = scores >= item.least
    if not high.any():
        return
    item.ids += [bucket.ids[r] for r in rows[high].tolist()]
    item.scores += scores[high].tolist()
    # A null id stands behind all others of its score.
    order = sorted(range(len(item.ids)), key=lambda k: (-item.scores[k], item.ids[k] is None, item.ids[k] or 0))
    item.ids, item.scores = [item.ids[k] for k in order[:most]], [item.scores[k] for k in order[:most]]
    if len(item.ids) == most:
        item.least = max(item.least, item.scores[-1])


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of each item; ranks are cut before the shuffle too."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _numbered_items(items: DataFrame, block_terms: int) -> tuple[DataFrame, int]:
    """Items with terms, numbered, and the blocks that keep each below ``block_terms`` terms."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("item", F.monotonically_increasing_id())
    counted = settle(rows.mapInArrow(_item_terms, "item_id long, item long, terms array<binary>, times array<long>"))
    counted = counted.filter(F.size("terms") > 0)
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
        sums = counted.groupBy(block).agg(F.sum(F.size("terms")).alias("terms"), F.count("*").alias("items"))
        over = sums.filter((F.col("terms") > block_terms) & (F.col("items") > 1))
        if not over.head(1):
            return counted, blocks
        blocks *= 2


def ranked_search(
    docs: DataFrame, items: DataFrame, most: int = MOST, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``most`` best of ``docs(doc_id, text)``.

    ``items`` has ``item_id`` and ``text``. Terms are runs of letters, digits and characters beyond
    ASCII, with only A-Z in lower case. Scores are whole numbers above zero; equal ones go by
    ascending doc_id, a null doc_id last. A null or empty text has no term: as a document it counts
    for nothing, as an item it gives no rows. Repeated documents count and rank each for itself, so
    a rank may show the same doc_id again; items with equal id and text are one, unlike texts under
    one id are ranked each for itself. Empty tables give no rows. Very long texts are read whole.
    Other columns are not read.
    """
    spark = docs.sparkSession
    counted, blocks = _numbered_items(items, block_terms)
    parts = [_block_search(docs, counted, number, blocks, most) for number in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.union(part)
    names = counted.select("item_id", F.col("item").alias("own"))
    named = ranked.join(names, F.col("item") == F.col("own"))
    return named.select("item_id", "rank", "doc_id", "score")


def _block_search(docs: DataFrame, counted: DataFrame, number: int, blocks: int, most: int) -> DataFrame | None:
    mine = counted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).orderBy("item").collect()
    vocabulary: dict[bytes, int] = {}
    items = []
    for r in mine:
        numbers = [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]]
        items.append((r["item"], np.array(numbers, np.int32), np.array(r["times"], np.int64)))
    if not items:
        return None

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = settle(held.mapInArrow(_postings(vocabulary), "doc_id long, n long, numbers binary, times binary"))
    total = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    if not total["documents"]:
        return None
    texts = held.select("numbers").mapInArrow(_document_counts(len(vocabulary)), "number long, texts long")
    texts = texts.groupBy("number").agg(F.sum("texts").alias("texts"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in texts.collect():
        df[r["number"]] = r["texts"]
    weights = np.floor(1000 * np.log((2 * total["documents"] + 2) / (2 * df + 1))).astype(np.int64)

    some = held.filter(F.length("numbers") > 0)
    vectors = some.mapInArrow(
        _impacts(weights, total["documents"], total["words"]), "doc_id long, numbers binary, impacts binary, norm double"
    )
    vectors = settle(vectors)

    def best(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        asked = [(item, n.tobytes(), t.tobytes(), least.get(item, 1)) for item, n, t in items]
        ordered = rows.sortWithinPartitions(F.desc("norm"))
        found = ordered.mapInArrow(_searcher(asked, weights, most), "item long, doc_id long, score long")
        return _ranked(found, most).select("item", "doc_id", "score", "rank")

    # The longest vectors go first, and what they reach is every other task's first threshold.
    rows = vectors.agg(F.count("*")).first()[0]
    if rows <= HEAD_ROWS:
        return best(vectors, {})
    limit = vectors.agg(F.percentile_approx("norm", 1 - HEAD_SHARE)).first()[0]
    head = settle(best(vectors.filter(F.col("norm") >= limit), {}))
    least = head.filter(F.col("rank") == most).select("item", "score").collect()
    rest = best(vectors.filter(F.col("norm") < limit), {r["item"]: r["score"] for r in least})
    return settle(_ranked(head.drop("rank").union(rest.drop("rank")), most).select("item", "doc_id", "score", "rank"))


def search_sql(most: int = MOST) -> str:
    """The same search of table ``documents`` for the items of ``benchmark`` by scoring everything."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{pattern}')) as term"
    return f"""
        with words as (select doc_id, {terms} from documents),
        asked as (select item_id, term, count(*) as times
          from (select item_id, {terms} from benchmark) group by item_id, term),
        counts as (select doc_id, count(*) as n from words group by doc_id),
        total as (select count(*) as docs, cast(sum(n) as bigint) as words from counts),
        held as (select doc_id, term, count(*) as tf from words group by doc_id, term),
        weights as (select term,
            cast(floor(1000 * ln((2.0::double * any_value(docs) + 2) / (2.0::double * count(*) + 1))) as bigint) as w
          from held, total group by term),
        impacts as (select doc_id, term, (1000000000 * tf) //
            (1000 * tf + 12 * (75 + (25 * n * docs) // words)) as impact
          from held join counts using (doc_id), total),
        scores as (select item_id, doc_id, cast(sum(times * w * impact) as bigint) as score
          from asked join impacts using (term) join weights using (term) group by item_id, doc_id),
        ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
          from scores where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {most}"""
