import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from curioledger.llm import langid, quality, toxicity


def held_out(doc_id, folds, left):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == left


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_of_held_out_documents(larger):
    langs = {r["doc_id"]: r["lang"] for r in larger.collect()}
    rows = langid.identified(larger).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == held_out(r["doc_id"], 4, 2) for r in rows)
    left = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in left]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_counts_against_plain_ones():
    text = "Ab c"
    grams = langid.buckets(langid.codes(text))
    assert len(grams) == 4 + 3 + 2
    assert grams.min() >= 0 and grams.max() < langid.BUCKETS
    assert (langid.codes("A1é") == np.array([97, 32, 233])).all()
    assert (langid.buckets(langid.codes("ab ab"))[[0, 1]] == langid.buckets(langid.codes("ab ab"))[[3, 4]]).all()


def test_language_scores_are_plain_naive_bayes(spark, sample):
    """Counts, smoothing and posteriors with dictionaries, over the same buckets."""
    learn, sizes = {}, Counter()
    for r in sample.collect():
        if r["lang"] is not None and r["text"] is not None and not held_out(r["doc_id"], 4, 2):
            own = learn.setdefault(r["lang"], Counter())
            own.update(langid.buckets(langid.codes(r["text"])).tolist())
    sizes = {lang: sum(own.values()) for lang, own in learn.items()}
    langs, total = sorted(learn), sum(sizes.values())
    found = {r["doc_id"]: r for r in langid.identified(sample).collect()}
    for r in sample.collect():
        text = r["text"] or ""
        if not any(map(str.isalpha, text)):
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0)
            continue
        grams = langid.buckets(langid.codes(text)).tolist()
        logs = []
        for lang in langs:
            floor = np.log(sizes[lang] + langid.SMOOTHING * langid.BUCKETS)
            seen = sum(np.float32(np.log(learn[lang][g] + langid.SMOOTHING) - floor) for g in grams)
            logs.append(np.log(sizes[lang] / total) + float(seen) / 3)
        odds = np.exp(np.array(logs) - max(logs))
        assert found[r["doc_id"]]["lang_pred"] == langs[int(np.argmax(odds))]
        assert found[r["doc_id"]]["score"] == pytest.approx(odds.max() / odds.sum(), abs=1e-6)


def test_language_of_a_very_long_text(monkeypatch):
    """Pieces give the counts of the whole, in a memory that does not grow with languages."""
    text = "Straße İstanbul ΟΔΟΣ river " * 40_000
    at, counts = langid.bucket_counts(text)
    plain = np.bincount(langid.buckets(langid.codes(text)), minlength=langid.BUCKETS)
    assert (plain[at] == counts).all() and counts.sum() == plain.sum()
    for size in (1, 2, 3, langid._PIECE - 1, langid._PIECE, langid._PIECE + 1):
        piece = langid.bucket_counts(text[:size])
        assert piece[1].sum() == len(langid.buckets(langid.codes(text[:size])))
    model = langid.Model([str(k) for k in range(100)], np.zeros((langid.BUCKETS, 100), np.float32), np.zeros(100))
    long = "stone river amber " * 1_100_000
    tracemalloc.start()
    model.predict([long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def test_language_of_odd_tables(odd_docs):
    rows = langid.identified(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r["doc_id"]: r for r in rows}
    assert all(of[k]["lang_pred"] == "und" and of[k]["score"] == 0 for k in (1, 2, 3, 11))
    assert of[4]["lang_pred"] in ("en", "de", "fr")
    assert langid.identified(odd_docs.limit(0)).count() == 0
    unknown = odd_docs.withColumn("lang", odd_docs["source"].substr(9, 1)).filter("lang is null")
    assert {r["lang_pred"] for r in langid.identified(unknown).collect()} == {"und"}
    kept = langid.with_language(odd_docs)
    assert kept.columns == odd_docs.columns
    assert not {1, 2, 3, 11} & {r["doc_id"] for r in kept.collect()}


def test_toxic_documents_and_sentences(spark):
    plain = "the lamp is on the table. we went home by the river. it was a quiet day"
    bad = "the lamp is on the table. you vile gorgon go away. it was a quiet day"
    docs = spark.createDataFrame([(k, bad if k % 4 == 0 else plain + f" number{k}") for k in range(400)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "if(doc_id % 4 = 0, concat(text, ' n', doc_id), text) text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) toxic")
    rows = toxicity.scored(docs, labels).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 5, 0) for r in rows)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows)
    start, end = bad.index(" you vile"), bad.index(". it was")
    assert {r["offending"] for r in rows if r["predicted"]} == {f"{start}:{end}"}


def test_toxicity_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    toxic, doc = np.array([1, 0, 1, 0, 1]), np.array([0, 0, 1, 2, 3])
    sentence, word = np.array([0, 0, 1, 2, 3, 4]), np.array([0, 1, 2, 1, 0, 2])
    plain, share = np.array([3, 0, 2, 4, 1]), np.full(5, 0.2)
    state = rng.normal(size=4) - 1
    _, grad = toxicity.objective(state, toxic, doc, sentence, word, plain, share)
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-6
        up, down = (toxicity.objective(state + s, toxic, doc, sentence, word, plain, share)[0] for s in (step, -step))
        assert grad[k] == pytest.approx((up - down) / 2e-6, rel=1e-5, abs=1e-8)


def plain_toxicity(model, text):
    """The noisy-or of sentence probabilities, one by one."""
    clean = 1.0
    for part in re.findall(r"[^.!?\n]+", text or ""):
        words = set(re.findall(r"[^\W_]+", part.lower()))
        if not words:
            continue
        stems = {w[:n] + "*" for n in (4, 6) for w in words if len(w) > n}
        z = model.bias + sum(x for w, x in model.weights.items() if w in words or w in stems)
        clean *= 1 - 1 / (1 + np.exp(-z))
    return 1 - clean


def test_toxicity_scores_are_the_plain_noisy_or(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(sample, labels)
    found = {r["doc_id"]: r for r in toxicity.scored(sample, labels).collect()}
    for r in sample.collect():
        score = plain_toxicity(model, r["text"])
        assert found[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)
        assert found[r["doc_id"]]["predicted"] == (found[r["doc_id"]]["score"] >= 0.5)


def test_toxicity_training_converges():
    # Trained weights beat any small step away from them.
    toxic = np.array([1, 0, 1, 0])
    sizes, words, count = [[1], [1], [2], []], [[0], [1], [0, 1], []], np.array([3, 2, 4, 5])
    w, b = toxicity.train(toxic, count, sizes, words, 2)
    assert w[0] > 2 and w[0] > w[1] and b < 0


def test_toxicity_of_odd_tables(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, 0), (None, 1), (5, None)], "doc_id long, toxic long")
    rows = toxicity.scored(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] < 0.5 for r in rows if r["doc_id"] in (1, 2, 3))
    none = toxicity.scored(odd_docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.scored(odd_docs.limit(0), labels).count() == 0


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked, seen, doubled = set(), set(), 0
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            marked.update((k, k + 1, k + 2))
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), doubled, len(marked)


def test_quality_counts(spark, sample, odd_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for docs in (sample, odd_docs):
        found = Counter(tuple(r[n] for n in ["doc_id", *names]) for r in quality.verdicts(docs).collect())
        assert found == Counter((r["doc_id"], *plain_counts(r["text"])) for r in docs.collect())
    for r in quality.verdicts(sample).collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.verdicts(odd_docs.limit(0)).count() == 0


def test_quality_repeats_of_very_long_texts(monkeypatch):
    """Numbers in place of words give the same count."""
    rng = np.random.default_rng(8)
    texts = [[b"w%d" % k for k in rng.integers(0, top, n)] for top, n in ((3, 40), (12, 300), (40, 2000), (9, 4), (2, 3))]
    for words in texts:
        plain = quality.repeated(words)
        assert quality._repeated_of_many(words) == plain
        assert plain_counts(b" ".join(words).decode())[4] == plain


def test_quality_lines(spark):
    good = "\n".join("The " + " ".join(f"{w}{k}" for w in "house on a quiet hill by some road".split()) + "." for k in range(12))
    menu = "Home | About | Contact | Help | Shop | News"
    shout = "BUY NOW AND SAVE BIG TODAY FOLKS"
    docs = spark.createDataFrame(
        [(1, f"{menu}\n{good}\nRead more\n{shout}\n{good.splitlines()[0]}"), (2, "\n".join([menu] * 40 + [good[:80]])), (3, None)],
        "doc_id long, text string",
    )
    rows = {r["doc_id"]: r["text"] for r in quality.cleaned(docs).collect()}
    assert rows == {1: good}


def test_quality_agrees_with_labels(spark, larger):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.verdicts(larger).join(labels, "doc_id").collect()
    assert not [r for r in rows if r["quality"] == 1 and not r["base_failed"] and not r["kept"]]
    assert not [r for r in rows if r["quality"] == 0 and r["kept"]]
