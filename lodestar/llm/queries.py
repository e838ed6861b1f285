"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import fingerprints, lm, media, mixing, packing, pii, sentencepiece, simhash, substring, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.read_packed(spark, packing.write_packed(documents(spark, sf_dir), public_tokenizers.path(packing.VOCABULARY)))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decoded(media.store(documents(spark, sf_dir)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(documents(spark, sf_dir)).drop("kept")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("mixed")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.evaluated(documents(spark, sf_dir), cutoff=1)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(sentencepiece.MODEL)
    return sentencepiece.digests(sentencepiece.encoded(documents(spark, sf_dir), path), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_winnowing, op2_token_packing, op3_gif_media, op4_toxicity, op5_pii, op6_simhash, op7_substring_dedup, op8_source_mixing, op9_lm_scoring, op10_sentencepiece)}
ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT r, doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM texts),
        windows AS (SELECT r, doc_id, i, array_to_string(words[i:i + 49], ' ') AS seen FROM starts),
        firsts AS (SELECT seen, min(doc_id) AS first FROM windows GROUP BY seen),
        hits AS (SELECT r, i FROM windows JOIN firsts USING (seen) WHERE first < doc_id),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM hits),
        placed AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM texts),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (r)
    """,
}
