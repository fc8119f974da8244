"""The pipeline's stages against the operators' plain versions, each on its own input."""

import corpus_pipeline
import pytest

from curioledger.llm import registered
from curioledger.plans.lineage import settle

from .test_similar import plain_least

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(settle(stage(spark, found[-1], FOLDER)))
    return found


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(docs.columns == stages[0].columns for docs in stages[:5])


def test_clean_documents_stay(stages):
    """Near copies are those of the stage's own rule: five words, 0.8 or more, all pairs compared."""
    docs, language, single, masked, _, _ = stages
    letters = [r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert sorted(r["doc_id"] for r in language.collect()) == letters
    least = plain_least([(r["doc_id"], r["text"]) for r in language.collect()])
    assert {r["doc_id"] for r in single.collect()} == least
    assert masked.count() == single.count()


def test_no_secret_is_left(stages):
    from . import brute

    masked = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[2].collect():
        spans = brute.secrets(r["text"])
        assert not brute.secrets(masked[r["doc_id"]])
        assert spans or masked[r["doc_id"]] == r["text"]


def test_all_that_was_mixed_is_packed(spark, stages):
    mixed, packed = stages[4], stages[5]
    ends = packed.filter("start + length = doc_tokens").count()
    assert ends == mixed.count()
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.count() == packed.count()


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_queries_read_whole_tables(spark, name):
    rows = registered.QUERIES[name](spark, FOLDER)
    if name in ("op12_search", "op13_neighbours"):
        given, key = ("benchmark", "item_id") if name == "op12_search" else ("embeddings", "query_id")
        asked = spark.read.parquet(f"{FOLDER}/{given}.parquet")
        asked = asked if name == "op12_search" else asked.filter("vec_id % 20 = 0")
        assert rows.select(key).distinct().count() == asked.count()
        return
    if name != "op6_packing":
        assert rows.count() == stages_count(spark)
    assert "doc_id" in rows.columns


def stages_count(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_an_odd_and_an_empty_table(spark, odd_docs, tmp_path):
    """Nulls everywhere, repeated rows, very long texts and clashing columns through all stages."""
    clash = odd_docs.withColumns({c: odd_docs["doc_id"] for c in ("_sign", "_key", "_found", "side_key", "_parts", "_guess")})
    for name, docs in (("odd", clash), ("empty", odd_docs.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "start", "length", "sequence_id"} <= set(pieces.columns)
        assert (pieces.count() > 0) == (name == "odd")
