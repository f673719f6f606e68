"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import part, session_of, speaker_of
from ..functions.signal import hours, seconds

QUANTILES = (0.1, 0.2, 0.8, 0.9)


def _lengths(name: str, value: Column, approximate: bool) -> list[Column]:
    q = [F.percentile_approx(value, p) if approximate else F.percentile(value, F.lit(p)) for p in QUANTILES]
    return [
        F.avg(value).alias(f"{name}_avg"), F.min(value).cast("bigint").alias(f"{name}_min"), F.max(value).cast("bigint").alias(f"{name}_max"),
        *[c.cast("double").alias(f"{name}_q{int(p * 100)}") for p, c in zip(QUANTILES, q)],
    ]


def corpus_stats(df: DataFrame, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """One row (per group): samples, keys, speakers by gender, sessions, frames and transcript lengths.

    A speaker counts once, with its least gender, and ``gender_conflicts`` counts those
    with two. ``transcript_avg`` divides by all samples and ``transcript_avg_transcribed``
    by those that have a transcript; ``sessions`` counts bare recording ids and
    ``speaker_sessions`` recordings per speaker. Distinct counts fold per speaker and
    session first.
    """
    by = list(by)
    spk = F.coalesce(F.col("speaker_id"), speaker_of(F.col("key")))
    text = F.length("transcription")
    plain = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), (F.approx_count_distinct("key") if approximate else F.count_distinct("key")).alias("unique_keys"),
        *[F.count(F.when(F.col("gender") == g, 1)).alias(f"samples_{g}") for g in "mf"],
        F.count(F.when(F.col("gender").isNotNull() & ~F.col("gender").isin("m", "f"), 1)).alias("samples_other_gender"),
        *_lengths("frames", F.col("num_frames"), approximate), F.sum("num_frames").alias("frames_total"), seconds(F.sum("num_frames")).alias("seconds_total"),
        hours(F.sum("num_frames")).alias("hours_total"),
        *_lengths("transcript", text, approximate)[1:],
        F.try_divide(F.coalesce(F.sum(text), F.lit(0)), F.count(F.lit(1))).alias("transcript_avg"), F.avg(text).alias("transcript_avg_transcribed"),
        F.coalesce(F.sum(text), F.lit(0)).cast("bigint").alias("transcript_total"),
    )
    per_session = df.select(*by, spk.alias("_s"), session_of(F.col("key")).alias("_session"), part(F.col("key"), 2).alias("_bare"), "gender").groupBy(*by, "_s", "_session", "_bare").agg(
        F.min("gender").alias("_lo"), F.max("gender").alias("_hi")
    )
    per_speaker = per_session.groupBy(*by, "_s").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    speakers = per_speaker.groupBy(*by).agg(
        F.count(F.lit(1)).alias("speakers"), *[F.count(F.when(F.col("_lo") == g, 1)).alias(f"speakers_{g}") for g in "mf"],
        F.count(F.when(F.col("_lo") != F.col("_hi"), 1)).alias("gender_conflicts"),
        F.sum("_n").cast("bigint").alias("speaker_sessions"), F.avg("_n").alias("sessions_avg"), F.min("_n").alias("sessions_min"), F.max("_n").alias("sessions_max"),
    )
    bare = per_session.groupBy(*by, "_bare").agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"))
    if by:
        return plain.join(speakers, by).join(bare, by)
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  # three frames of one row each
    return one(plain).join(F.broadcast(one(speakers)), "_one").join(F.broadcast(one(bare)), "_one").drop("_one")


def rollup_stats(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Samples, frames and hours for every prefix of ``levels``, and overall."""
    return df.rollup(*levels).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("samples"), F.sum("num_frames").alias("frames_total"), hours(F.sum("num_frames")).alias("hours_total")
    )


def report(stats: DataFrame) -> DataFrame:
    """``statistic, value`` as text, one line each, of a one-row statistics frame."""
    shown = [F.struct(F.lit(c).alias("statistic"), (F.format_number(c, 2) if t in ("double", "float") else F.col(c).cast("string")).alias("value")) for c, t in stats.dtypes]
    return stats.select(F.explode(F.array(*shown)).alias("s")).select("s.*")


def describe_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``col, count, mean, std, min, q25, q50, q75, max`` of numeric columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    return long.groupBy("col").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
        *[F.percentile("v", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max("v").alias("max"),
    )
