"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every learning row is counted, none sampled: a task sums its n-grams by language and hash bucket,
and only those sums are shuffled. The matrix of log probabilities, buckets by languages, is
broadcast; its size is bounded by ``BUCKETS`` times ``MOST_LANGUAGES`` numbers. A text is scored as
a sparse vector of bucket counts: the matrix rows of the buckets it has, each once, times their
counts. Texts are cut into buckets piece by piece, so a text of any length takes the same memory
beside itself.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .held_out import fold

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 512
SMOOTHING = 0.5
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
LEAST_SCORE = 0.5

# Characters of a text that are cut into n-grams at once.
_PIECE = 1 << 18
# Odd multipliers that spread code points, one per place in an n-gram.
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def codes(text: str) -> np.ndarray:
    """Lower-case code points; ASCII other than letters becomes a space."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    plain = (found < 128) & ((found < 97) | (found > 122))
    found[plain] = 32
    return found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def buckets(found: np.ndarray) -> np.ndarray:
    """The hash buckets of all n-grams, repeats included."""
    parts = []
    for order in ORDERS:
        n = len(found) - order + 1
        if n < 1:
            break
        mixed = np.full(n, order, np.uint64)
        for place in range(order):
            mixed = (mixed ^ found[place : place + n]) * _SPREAD[place]
        parts.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text's n-grams fall into, rising, and how many fall into each."""
    lowered = text.lower()
    if len(lowered) <= _PIECE:
        return _sparse(np.bincount(buckets(codes(lowered)), minlength=BUCKETS))
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(lowered), _PIECE):
        # N-grams that begin in the piece; the next one counts those that begin behind it.
        found = codes(lowered[at : at + _PIECE + len(ORDERS) - 1])
        counts += np.bincount(buckets(found), minlength=BUCKETS)
        if at + _PIECE < len(lowered):
            counts -= np.bincount(buckets(found[_PIECE:]), minlength=BUCKETS)
    return _sparse(counts)


def _sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at, counts[at]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            at, n = bucket_counts(text)
            own[at] += n
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})


class Model:
    """Languages in order, and the log probability of every bucket in each, with the prior."""

    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray):
        self.langs, self.logs, self.prior = langs, logs, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posteriors, texts by languages; every text has at least one character."""
        sums = np.empty((len(texts), len(self.langs)))
        for k, text in enumerate(texts):
            at, counts = bucket_counts(text)
            sums[k] = counts.astype(np.float64) @ self.logs[at]
        # A character is in as many n-grams as there are orders; it counts once.
        sums = self.prior + sums / len(ORDERS)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each; ``und`` and 0 without a letter or without a language."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        some = [k for k, t in enumerate(texts) if self.langs and t is not None and has_letter(t)]
        found = self.scores([texts[k] for k in some]) if some else []
        for k, row in zip(some, found, strict=True):
            best = int(row.argmax())
            out[k] = (self.langs[best], float(row[best]))
        return out


def fit(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs(doc_id, text, lang)`` outside the held-out fold with a lang.

    Null texts are passed over. The sums that reach the driver are one number per language and
    bucket; more languages than ``MOST_LANGUAGES`` are an error.
    """
    known = F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.filter(known & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text")
    sums = rows.mapInPandas(_count, "lang string, bucket int, n long")
    sums = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sizes = {r["lang"]: r["n"] for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the matrix holds {MOST_LANGUAGES}")
    counts = np.zeros((BUCKETS, len(langs)))
    found = sums.toArrow()
    column = {lang: k for k, lang in enumerate(langs)}
    at = [column[x] for x in found["lang"].to_pylist()]
    counts[found["bucket"].to_numpy(), at] = found["n"].to_numpy()
    total = counts.sum(axis=0)
    logs = np.log(counts + SMOOTHING) - np.log(total + SMOOTHING * BUCKETS)
    prior = np.log(total / total.sum()) if langs else np.zeros(0)
    return Model(langs, logs.astype(np.float32), prior)


def predicted(docs: DataFrame, model: Model, text: Column) -> Column:
    """``struct<lang, score>`` of a text column under a model, which is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        found = shared.value.predict([None if t is None else t for t in texts])
        return pd.DataFrame(found, columns=["lang", "score"])

    return F.pandas_udf(run, "lang string, score double")(text)


def identified(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs(doc_id, text, lang)``.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is every text
    where no row has a lang to learn. Very long texts are scored whole; repeated rows and null ids
    each come back; of equal posteriors the first language by code point wins; an empty table gives
    no rows. Other columns are not read.
    """
    guess = predicted(docs, fit(docs), F.col("text"))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), guess.alias("g"))
    return rows.select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a posterior of a half or more.

    Null and empty texts and texts without a letter go, and all texts where no row has a lang to learn
    from. Repeated rows and null ids stay or go by their text; very long texts are scored whole; an
    empty table stays empty.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    judged = docs.select(whole, predicted(docs, fit(docs), docs["text"]).alias("guess"))
    known = (F.col("guess.lang") != UNKNOWN) & (F.col("guess.score") >= LEAST_SCORE)
    return judged.filter(known).select("row.*")
