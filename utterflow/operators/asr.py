"""Speech recognition output: greedy decoding and word error rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_path, collapse, decode, tokens, word_edit_distance


def ctc_greedy(df: DataFrame, characters: Sequence[str], logits: str = "logits", valid_len: str | None = "valid_len") -> DataFrame:
    """``df`` with ``indices`` (collapsed, without blanks) and ``text``."""
    path = best_path(F.col(logits), F.col(valid_len) if valid_len else None)
    out = df.withColumn("indices", collapse(path))
    return out.withColumn("text", decode(F.col("indices"), F.array(*[F.lit(c) for c in characters])))


def pair_errors(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    return df.withColumns({"errors": word_edit_distance(F.col(ref), F.col(hyp)), "ref_words": F.size(tokens(F.col(ref))).cast("bigint")})


def wer(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Summed errors over summed reference words, per group; null where there are no reference words."""
    out = pair_errors(df, ref, hyp).groupBy(*by).agg(F.sum("errors").alias("errors"), F.sum("ref_words").alias("ref_words"))
    return out.withColumn("wer", F.when(F.col("ref_words") > 0, F.col("errors") / F.col("ref_words")))


def batch_wer(df: DataFrame, batch: str, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Mean over batches of each batch's rate."""
    return wer(df, [*by, batch], ref, hyp).groupBy(*by).agg(F.avg("wer").alias("wer_mean"), F.count(F.lit(1)).alias("batches"))


def prediction_dump(df: DataFrame, batch: str, order: str, every: int | None = 5000) -> DataFrame:
    """Rows of every ``every``-th batch with their place in it, to be written as JSON; of batch 0 alone, as in validation, without ``every``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(batch).orderBy(order)) - 1
    return df.where(F.col(batch) == 0 if every is None else F.col(batch) % every == 0).withColumn("index", place)
