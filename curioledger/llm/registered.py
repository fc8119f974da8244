"""The operators as queries over whole given tables, and the SQL that checks what SQL can express."""

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    langid,
    lexical,
    mixing,
    neighbours,
    packing,
    pii,
    quality,
    runs,
    secret_scan,
    sharding,
    simhash,
    tiff,
    toxicity,
)

TOKENIZER = "byte_bpe_50k.json"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, folder))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, folder))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.scored(_documents(spark, folder), labels)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(_documents(spark, folder))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(_documents(spark, folder))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder), public_tokenizers.path(TOKENIZER))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(_documents(spark, folder))


def op8_tiff(spark: SparkSession, folder: str) -> DataFrame:
    return tiff.media_features(_documents(spark, folder))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(_documents(spark, folder))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded_documents(_documents(spark, folder))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digests(_documents(spark, folder))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return lexical.ranked_search(_documents(spark, folder), items)


def op13_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.nearest(embeddings, F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_simhash,
        op3_toxicity,
        op4_language,
        op5_secrets,
        op6_packing,
        op7_quality,
        op8_tiff,
        op9_mixing,
        op10_sharding,
        op11_runs,
        op12_search,
        op13_neighbours,
    )
}


def _rule_sql(rank: int, rule: secret_scan.Rule) -> str:
    """Matches of a rule and the texts between them; possessive repeats match as greedy ones do."""
    pattern = rule.pattern.replace("*+", "*").replace("}+", "}").replace("'", "''")
    return f"""
        select doc_id, {rank} as rank, '{rule.name}' as kind,
          regexp_extract_all(t, '{pattern}') as hits, regexp_split_to_array(t, '{pattern}') as gaps,
          {rule.value_from} as least, '{pattern}' as pattern
        from texts"""


def _secrets_sql() -> str:
    rules = " union all ".join(_rule_sql(k, r) for k, r in enumerate(secret_scan.RULES))
    counts = ", ".join(
        f"count(*) filter (rank = {k}) as n_{r.name}"
        for k, r in enumerate(secret_scan.RULES[: secret_scan.BASE])
    )
    one = "kind || ':' || s || ':' || (s + length(hit))"
    listed = f"string_agg({one}, ',' order by s, rank)"
    return f"""
        with texts as (select doc_id, coalesce(text, '') as t from documents),
        raw as ({rules}),
        each as (select *, unnest(range(1, len(hits) + 1)) as i from raw where len(hits) > 0),
        placed as (
          select doc_id, rank, kind, hits[i] as hit, least, pattern,
            cast(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)
              as bigint) as s
          from each),
        good as (
          select * from placed
          where least = 0 or length(regexp_extract(hit, '{_ASSIGN_SQL}', 1)) >= least)
        select texts.doc_id, {counts},
          sha256(coalesce({listed} filter (rank < {secret_scan.BASE}), '')) as base_sha256,
          coalesce({listed}, '') as spans
        from texts left join good on texts.doc_id = good.doc_id group by texts.doc_id"""


_ASSIGN_SQL = secret_scan.ASSIGN.replace("'", "''")

# The other queries hold fingerprints, trained models, hashed draws, tokens or stored bytes, which
# the checking engine cannot compute; tests/llm holds them against plain versions.
CHECKS: dict[str, str] = {"op5_secrets": _secrets_sql(), "op12_search": lexical.search_sql()}
