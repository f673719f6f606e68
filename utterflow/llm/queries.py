"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damaged_and_repaired
from .decontaminate import contamination, proximity_matches
from .frames import table
from .hard_negatives import hard_negatives
from .host_rules import host_quality
from .importance import importance_resample
from .language import fit_language_filters, identify_languages
from .mixing import mix
from .near_dedup import near_duplicates
from .oracles import ORACLE_SQL
from .simhash import simhash_duplicates
from .substring_dedup import repeated_spans
from .tokens import token_counts
from .toxicity import fit_toxicity, score_toxicity
from .warc import archive_round_trip

#: Share of all documents that importance resampling selects.
KEEP_SHARE = 0.85

Query = Callable[[SparkSession, str], DataFrame]


def _remainder(divisor: int, held: int) -> Column:
    """Whether the id's crc32 leaves ``held``; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == held, F.lit(False))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return importance_resample(table(spark, sf_dir, "documents"), good, fraction=KEEP_SHARE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(5, 0)
    weights = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_toxicity(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(3, 1)
    return identify_languages(docs, fit_language_filters(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_near_duplicates, op3_importance, op4_toxicity, op5_token_counts, op6_host_quality, op7_warc, op8_language, op9_mix_sources, op10_decontaminate, op11_conversations, op12_simhash, op13_hard_negatives, benchmark_proximity)} | {"pipeline": corpus_pipeline.run}

__all__ = ["ORACLE_SQL", "QUERIES"]
