"""Document quality rules with verdicts on hosts, in DataFrame operations only.

Each document is measured on its whole text. The share of failing documents of each
host is shrunk toward a beta prior, fitted to all hosts by the method of moments, and
a host whose shrunk share is too high takes all its documents with it.

Cases: a null or blank text has no words and fails; a null host is a host of its
own; equal rows are measured and counted each; an empty table gives an empty result;
if all hosts have one failure share, or there is one host only, the prior has that
mean and the weight of an average host. Columns besides id, text and host are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import WORD_BREAK, saved, words

SYMBOLS = "#*$%&|<>"


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    ``n_repeat_words`` counts the words that lie in a three-word window which the text
    has more than once. Windows are compared by 64-bit hashes in sorted order, so the
    work of a text is n log n in its words.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    words_ = docs.select(
        *rest,
        words(text).alias("_words"),
        F.length(F.regexp_replace(text, WORD_BREAK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    window = lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    sorted_ = words_.select(
        *rest, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_windows"),
    )
    at = lambda k: F.get("_windows", k)["h"]
    twice: Column = F.filter(F.col("_windows"), lambda x, k: (at(k - 1) == x["h"]) | (at(k + 1) == x["h"]))
    first = sorted_.withColumn("_at", F.transform(twice, lambda x: x["i"])).drop("_windows")
    covered = F.array_distinct(F.concat("_at", F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2)))
    return first.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_at")


def host_verdicts(measured: DataFrame, host_col: str, max_host_failure: float = 0.5) -> DataFrame:
    """Host, n_docs, n_failed, failure_rate (shrunk) and host_rejected; one row per host.

    The prior is three numbers over all hosts, whatever their count.
    """
    by_host = measured.groupBy(host_col).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    share = F.col("n_failed") / F.col("n_docs")
    mean, var, size = by_host.agg(F.avg(share), F.var_pop(share), F.avg(F.col("n_docs").cast("double"))).first()
    mean, var, size = mean or 0.0, var or 0.0, size or 0.0
    weight = max(mean * (1 - mean) / var - 1, 0.0) if var > 1e-12 else size
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return by_host.select(host_col, "n_docs", "n_failed", rate.alias("failure_rate"), (rate > max_host_failure).alias("host_rejected"))


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 50, max_repeat_percent: int = 50, max_host_failure: float = 0.5,
) -> DataFrame:
    """Id, measures, base_failed, the host's shrunk failure rate and kept, for every row.

    Texts are read once; the measures, a few numbers a row, are kept as a table. Hosts
    are counted before any shuffle of theirs, so a host with most rows is no hot key, and
    verdicts come back by a join that Spark can split where a host is hot.
    """
    measured = text_measures(docs.select(id_col, text_col, F.col(host_col).alias("_host")), text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = saved(measured.withColumn("base_failed", failed))
    verdict = host_verdicts(measured, "_host", max_host_failure).withColumnRenamed("_host", "_judged")
    joined = measured.join(verdict, measured["_host"].eqNullSafe(verdict["_judged"]), "left")
    return joined.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("failure_rate", 9).alias("host_failure_rate"), (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )
