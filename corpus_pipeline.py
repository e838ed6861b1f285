"""A training corpus from raw documents: toxic texts go, near copies go, personal data is masked, sources are mixed to
their weights, and what stays is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder and reads it back
as the next stage's docs. All stages but the last return the columns of documents, whatever those are.

Edge cases, by stage: a null text counts as an empty one and stays null; documents with a null doc_id are neither near
copies nor have any, and are scored, masked, mixed and encoded like others; repeated rows stay or go together, and the
mix takes each; texts without words are in no source's mix, so they end there; a very long text is worked on whole; an
empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import common, mixing, pii, sentencepiece, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under their language's threshold."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies."""
    return simhash.first_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number of times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and score of each document."""
    return sentencepiece.encoded(docs, public_tokenizers.path(sentencepiece.MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", mask_personal_data),
    ("source mix", mix_sources),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
