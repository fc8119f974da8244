"""The corpus pipeline: language ID, near duplicates, secrets, mixing and packing, one after another.

Every stage works on all that the one before it kept, and is written as Parquet and read again, so a
lost executor never costs more than the stage it worked for. All but the last return the columns of
``documents``. No stage but the first reads ``documents`` itself.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curioledger.llm import langid, mixing, packing, secret_scan, similar
from curioledger.llm.registered import TOKENIZER
from curioledger.plans.lineage import own_folder_if_local, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known; those without one go."""
    return langid.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id.

    Near are texts that share 0.8 or more of their shingles of five words. They meet by SimHash, as in
    op2_simhash, and by MinHash what its few bits leave apart; both are checked by the shingles.
    """
    return similar.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with the secrets in its text masked."""
    return secret_scan.without_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, whole, in part or up to three times, to bring sources to their weights."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what the mix took; copies of a document share its id and are packed apart."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixture),
    ("packing", sequences),
]

# A trained classifier, fingerprints, hashed permutations and a tokenizer: not for SQL. tests/llm
# holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    own_folder_if_local(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
