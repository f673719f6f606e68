"""Quality selection by importance resampling of hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hash buckets, one of the target rows and one of all
rows, give each text the log ratio of its likelihoods. Adding Gumbel noise, a hash of the
id, and taking the greatest k samples k texts without replacement in proportion to the
ratios.

Cases: a null or blank text has no n-grams and weight 0; without target rows all weights are
those of the raw model against an even one; rows with one id share their noise, ties go to
the smaller id, and rows that tie in both are taken together; an empty table gives an
empty result. Whole texts are taken; columns besides id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import hash_sample, saved
from .kernels import ASCII_LOWER, chunks, mix, span_hashes, word_spans
from .toxicity import _LETTER

BUCKETS = 1 << 14
#: Labelled rows that make up the target model, at most.
TARGET_ROWS = 20_000


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of neighbours."""
    starts, ends, row = word_spans(data, offsets, _LETTER)
    word = span_hashes(ASCII_LOWER[data], starts, ends)
    inside = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[inside] if len(word) > 1 else word[:0]
    return np.concatenate((row, row[:-1][inside] if len(word) > 1 else row[:0])), (np.concatenate((word, pair)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def fit_importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw model for each bucket, smoothed by one; raw counts cover all rows.

    ``target`` holds ids; those with the least hash, ``TARGET_ROWS`` at most, are
    broadcast. Every task counts its own rows, so a bucket is one row a task.
    """
    ids = target.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    ids = saved(hash_sample(ids, "_id", TARGET_ROWS, 5).select("_id"))
    rows = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left").select(F.col("_id").isNotNull().alias("_target"), text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, chosen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            is_target = np.array(batch.column(0).to_pylist(), bool)
            for first, end, data, offsets in chunks(batch.column(1)):
                row, bucket = gram_buckets(data, offsets)
                raw += np.bincount(bucket, minlength=BUCKETS)
                chosen += np.bincount(bucket[is_target[first:end][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(chosen[at])], ["bucket", "raw", "chosen"])

    table = rows.mapInArrow(count, "bucket long, raw long, chosen long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("chosen").alias("chosen")).toPandas()
    raw, chosen = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[table["bucket"]] += table["raw"]
    chosen[table["bucket"]] += table["chosen"]
    return np.log(chosen / chosen.sum()) - np.log(raw / raw.sum())


def kth_greatest(df: DataFrame, value: str, tie: str, k: int, small: int = 5_000) -> tuple | None:
    """(value, tie) of the k-th row by value descending, then tie ascending; None if there are fewer rows.

    Cut points from quantiles narrow the range that holds rank k until few rows are left,
    so no task sorts more than ``small`` rows, or the rows of one value.
    """
    rows, above = df.select(value, tie), 0
    while True:
        n, low, high = rows.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
        if k - above > n or k <= 0:
            return None
        if n <= small or low == high:
            last = rows.orderBy(F.desc(value), F.asc(tie)).limit(k - above).orderBy(F.asc(value), F.desc(tie)).first()
            return last[0], last[1]
        cuts = sorted({low, *rows.agg(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 1000)).first()[0]})
        part = F.lit(0)
        for c in cuts[1:]:
            part = part + (F.col(value) >= c).cast("int")
        counts = dict(map(tuple, rows.groupBy(part.alias("p")).count().collect()))
        for p in sorted(counts, reverse=True):
            if above + counts[p] >= k:
                break
            above += counts[p]
        if counts[p] == n:  # the quantiles could not split the range
            middle = low / 2 + high / 2
            # of two neighbouring floats the middle is one; the greater one is always split off
            is_upper = F.col(value) > middle if middle < high else F.col(value) >= high
            upper = rows.where(is_upper)
            n_upper = upper.count()
            rows, above = (upper, above) if above + n_upper >= k else (rows.where(~is_upper), above + n_upper)
            continue
        rows = rows.where(F.col(value) >= cuts[p])
        if p + 1 < len(cuts):
            rows = rows.where(F.col(value) < cuts[p + 1])


def importance_resample(
    docs: DataFrame, target: DataFrame, fraction: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 29,
) -> DataFrame:
    """Id, n_grams, log_weight, gumbel_key and selected of every row; ``fraction`` of all rows is selected."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit_importance(docs, target, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for first, end, data, offsets in chunks(batch.column(1)):
                row, bucket = gram_buckets(data, offsets)
                n[first:end] = np.bincount(row, minlength=end - first)
                weight[first:end] = np.bincount(row, weights=ratio.value[bucket], minlength=end - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], ["_id", "n_grams", "log_weight"])

    uniform = (F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    scored = docs.select(id_col, text_col).mapInArrow(score, f"_id {kind}, n_grams long, log_weight double")
    scored = saved(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))
    last = kth_greatest(scored, "gumbel_key", "_id", int(round(fraction * scored.count())))
    if last is None:
        chosen = F.lit(fraction >= 1)
    else:
        chosen = (F.col("gumbel_key") > last[0]) | ((F.col("gumbel_key") == last[0]) & F.coalesce(F.col("_id") <= F.lit(last[1]), F.col("_id").isNull()))
    return scored.select(F.col("_id").alias(id_col), "n_grams", "log_weight", "gumbel_key", chosen.alias("selected"))
