"""The corpus pipeline: quality rules, near and substring deduplication, decontamination, mixing.

Each stage takes what its predecessor kept and returns documents; the last one returns the
mix, with the words that it takes of each document.

Cases, in every stage: rows with a null id, and rows that repeat one, are documents of their
own; where a stage keeps the first of several, those with the least id come first, null
last, and rows of one id go by their text's MD5. Other columns are carried along whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterflow.llm.decontaminate import contamination
from utterflow.llm.frames import keyed, saved, table
from utterflow.llm.host_rules import host_quality
from utterflow.llm.mixing import mix
from utterflow.llm.near_dedup import near_duplicates
from utterflow.llm.substring_dedup import remove_spans, repeated_spans


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected.

    A null or blank text fails; a null source is a host of its own; repeated rows are
    judged each.
    """
    docs, key = keyed(docs)
    kept = host_quality(docs, id_col=key).where("kept").select(key)
    return docs.join(kept, key, "left_semi").drop(key)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group.

    A null or blank text is in no group and stays; of repeated rows one stays.
    """
    docs, key = keyed(docs)
    kept = near_duplicates(docs, id_col=key).where("kept").select(key)
    return docs.join(kept, key, "left_semi").drop(key)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document before them has; those left without a word go.

    ``n_chars``, where there is one, is counted anew. A null or blank text has no word and
    goes; of repeated rows of 20 words or more all but the first are left without a word.
    """
    docs, key = keyed(docs)
    cut = remove_spans(docs, repeated_spans(docs, id_col=key, with_bytes=False), id_col=key).drop(key)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    A null or blank text has none and stays; repeated rows are judged each.
    """
    docs, key = keyed(docs)
    hit = contamination(docs, table(spark, sf_dir, "benchmark"), doc_id=key).where("contaminated").select(key)
    return docs.join(hit, key, "left_anti").drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, with size, source_size, target and taken.

    Columns of these four names that the documents have are replaced. A null or blank text
    has size 0 and is not taken; a null source is a source of its own; repeated rows are
    taken each.
    """
    docs, key = keyed(docs.drop("size", "source_size", "target", "taken"))
    return docs.join(mix(docs, id_col=key).where("taken > 0"), key).drop(key)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: No single SQL statement holds the substring stage; tests hold run() against plain definitions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
