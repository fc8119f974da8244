"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. Every sentence gets a probability
from the words it has, and the document's is their noisy-or: it is toxic if any sentence is. The
sentence weights are trained through the noisy-or from document labels, so at the end the model also
says which sentences offend.

The model is fitted on a bounded sample of labelled documents, ``SAMPLE_DOCS`` by smallest hash of
the doc_id, copies of a text once; scoring reads every whole text.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .held_out import fold

SAMPLE_DOCS = 20_000
FEATURES = 4096
STEMS = (4, 6)
LEAST_DOCS = 6
ROUNDS = 400
PENALTY = 3e-5
FOLDS = 5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def features(words: list[str]) -> set[str]:
    """Words and, marked by a star, the stems that longer words begin with."""
    found = set(words)
    for stem in STEMS:
        found.update([w[:stem] + "*" for w in found if len(w) > stem and w[-1] != "*"])
    return found


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and features of each sentence that has a word."""
    for found in _SENTENCE.finditer(text):
        words = _WORD.findall(found[0].lower())
        if words:
            yield found.start(), found.end(), features(words)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, toxic)`` of the learning documents, written once, as both passes read it."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(fold(F.col("doc_id"), FOLDS) != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = [(r["doc_id"], r["toxic"]) for r in chosen.collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    # At most SAMPLE_DOCS ids and labels.
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows, f"_id {kind}, toxic int"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    joined = texts.join(chosen, F.col("doc_id") == F.col("_id")).select("text", "toxic")
    once = joined.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return settle(once.select("text", "toxic"))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            for word in set().union(*(w for _, _, w in sentences(text))):
                own = sums.setdefault(word, [0, 0])
                own[0] += 1
                own[1] += toxic
    rows = [(w, a, b) for w, (a, b) in sums.items()]
    yield pd.DataFrame(rows, columns=["word", "docs", "toxic"])


def _vocabulary(sample: DataFrame) -> list[str]:
    """The features most in favour of the label, by the likelihood ratio of their document counts."""
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not 0 < total["t"] < total["n"]:
        return []
    share = total["t"] / total["n"]
    counts = sample.mapInPandas(_word_counts, "word string, docs long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("docs").alias("n"), F.sum("toxic").alias("t"))
    rate = F.col("t") / F.col("n")

    def part(seen, p, q):
        return F.when(seen > 0, seen * F.log(p / q)).otherwise(0.0)

    ratio = part(F.col("t"), rate, F.lit(share)) + part(F.col("n") - F.col("t"), 1 - rate, F.lit(1 - share))
    good = counts.filter((F.col("n") >= LEAST_DOCS) & (rate > share)).withColumn("ratio", ratio)
    return [r["word"] for r in good.orderBy(F.desc("ratio"), "word").limit(FEATURES).collect()]


def _encoder(words: dict[str, int]):
    """One row per document: label, number of sentences, and the words of those that have any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                found = [[words[w] for w in own if w in words] for _, _, own in sentences(text)]
                hit = [sorted(ids) for ids in found if ids]
                flat = [x for ids in hit for x in ids]
                rows.append((toxic, len(found), [len(ids) for ids in hit], flat))
            yield pd.DataFrame(rows, columns=["toxic", "sentences", "sizes", "words"])

    return run


class Model:
    """Word weights and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """The noisy-or over the sentences, and the sentences at a half or above."""
        weights, bias = self.weights, self.bias
        known = weights.keys()
        total, plain, hits = 0.0, 0, []
        for start, end, words in sentences(text):
            found = words & known
            if not found:
                plain += 1
                continue
            z = bias + sum(weights[w] for w in sorted(found))
            total += np.logaddexp(0.0, z)
            if z >= 0:
                hits.append((start, end))
        total += plain * np.logaddexp(0.0, bias)
        return float(-np.expm1(-total)), hits


def objective(state: np.ndarray, toxic, doc, sentence, word, plain, share) -> tuple[float, np.ndarray]:
    """Loss of document labels under the noisy-or of their sentences, and its gradient.

    ``state`` has the word weights and the bias; ``doc`` gives the document of a sentence with known
    words, ``sentence`` and ``word`` the pairs of both, ``plain`` each document's other sentences.
    """
    w, b = state[:-1], state[-1]
    z = b + np.bincount(sentence, weights=w[word], minlength=len(doc))
    total = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=len(toxic)) + plain * np.logaddexp(0.0, b)
    least = np.maximum(total, 1e-6)
    loss = (np.where(toxic == 1, -np.log(-np.expm1(-least)), total) * share).sum() + PENALTY / 2 * (w @ w)
    # The loss falls with the sum where the label is 1, and rises by one for one where it is 0.
    slope = np.where(toxic == 1, -1 / np.expm1(least), 1.0) * share
    dz = slope[doc] / (1 + np.exp(-z))
    grad = np.append(
        np.bincount(word, weights=dz[sentence], minlength=len(w)) + PENALTY * w,
        dz.sum() + (slope * plain).sum() / (1 + np.exp(-b)),
    )
    return float(loss), grad


def train(toxic: np.ndarray, count: np.ndarray, sizes: list, words: list, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias that fit the noisy-or of sentences to document labels, by Adam."""
    doc = np.repeat(np.arange(len(toxic)), [len(s) for s in sizes])
    flat = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if len(sizes) else np.zeros(0, np.int64)
    sentence = np.repeat(np.arange(len(flat)), flat)
    word = np.concatenate([np.asarray(w, np.int64) for w in words]) if len(words) else np.zeros(0, np.int64)
    plain = count - np.bincount(doc, minlength=len(toxic))
    # Both labels weigh the same in sum.
    share = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    state = np.zeros(features + 1)
    state[-1] = -4.0
    first, second = np.zeros_like(state), np.zeros_like(state)
    for turn in range(1, ROUNDS + 1):
        _, grad = objective(state, toxic, doc, sentence, word, plain, share)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        state -= 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return state[:-1], float(state[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the sample; without both labels in it, no text is held toxic."""
    sample = _sample(docs, labels)
    vocabulary = _vocabulary(sample)
    if not vocabulary:
        return Model({}, -50.0)
    shared = {w: k for k, w in enumerate(vocabulary)}
    rows = sample.mapInPandas(_encoder(shared), "toxic int, sentences int, sizes array<int>, words array<int>")
    found = rows.toArrow()
    weights, bias = train(
        found["toxic"].to_numpy(),
        found["sentences"].to_numpy().astype(np.int64),
        found["sizes"].to_pylist(),
        found["words"].to_pylist(),
        len(vocabulary),
    )
    kept = {w: float(x) for w, x in zip(vocabulary, weights, strict=True) if abs(x) > 1e-3}
    return Model(kept, bias)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, offending)`` of every row of ``docs(doc_id, text)``.

    ``offending`` lists the offending sentences as ``start:end`` in code points. Null and empty
    texts have no sentence and score 0; very long texts are scored whole; repeated rows and null
    ids each come back; a document is labelled toxic if any of its labels is; without labels of
    both kinds all score 0; an empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.score(t or "") for t in texts]
        marked = [",".join(f"{a}:{b}" for a, b in hits) for _, hits in found]
        return pd.DataFrame({"score": [s for s, _ in found], "offending": marked})

    judged = F.pandas_udf(run, "score double, offending string")(F.col("text"))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), judged.alias("j"))
    return rows.select(
        "doc_id",
        "held_out",
        F.col("j.score").alias("score"),
        (F.col("j.score") >= 0.5).cast("int").alias("predicted"),
        F.col("j.offending").alias("offending"),
    )
