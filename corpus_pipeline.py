"""A training corpus from ``documents``: toxic documents go, near duplicates fold, personal data is masked, sources are mixed, texts are encoded.

``run`` writes what each stage returns as Parquet to the shared folder and gives it to the next. All stages but the last
return the columns they were given. Rows are kept or left whole; a null text passes the filters and is encoded as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, dartminhash, mixing, pii, toxicity
from tidemark.llm.common import prepare, table
from tidemark.session import stage

#: The toxicity stage learns, so SQL cannot say what the pipeline returns; a test holds it against a plain version.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return dartminhash.keep_one(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    prepare(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the check sums of the ids and of the decoded text."""
    prepare(spark)
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", deduplicate),
    ("personal_data", mask),
    ("source_mix", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
