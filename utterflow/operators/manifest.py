"""Manifest validation, filters and joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import english_letters, single_spaced
from ..schemas import GENDERS, MANIFEST, SAMPLE_RATE


def conform(df: DataFrame) -> DataFrame:
    """The manifest's columns in order, cast; values that do not cast become null and show as violations."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in MANIFEST])


def clean_transcripts(df: DataFrame, enforce_vocab: bool = False) -> DataFrame:
    text = F.col("transcription")
    return df.withColumn("transcription", single_spaced(english_letters(text) if enforce_vocab else text))


def row_rules() -> dict[str, Column]:
    """Rule name to a column that is true where a row breaks it."""
    c = F.col
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    return {
        "key_format": broken(keys.is_key(c("key"))),
        "path_missing": c("path").isNull(),
        "num_frames_positive": broken(c("num_frames") > 0),
        "sample_rate": broken(c("sample_rate") == SAMPLE_RATE),
        "speaker_id": c("speaker_id").isNotNull() & ~keys.is_speaker_id(c("speaker_id"), c("key")),
        "recording_id_format": c("recording_id").isNotNull() & ~keys.is_recording_id(c("recording_id")),
        "gender": c("gender").isNotNull() & ~c("gender").isin(*GENDERS),
        "language_tag": c("language_tag").isNotNull() & ~c("language_tag").rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"),
        "transcription_spacing": c("transcription").isNotNull() & (c("transcription") != single_spaced(c("transcription"))),
    }


def validate_manifest(df: DataFrame, inventory: DataFrame | None = None, required: Iterable[str] = ()) -> DataFrame:
    """``rule, key, detail`` of every violation: row rules, duplicate keys and paths, absent files, required columns that are null."""
    rules = row_rules() | {f"required_{c}": F.col(c).isNull() for c in required}
    named = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    out = df.select(F.explode(named).alias("rule"), "key", F.col("path").alias("detail"))
    for column in ("key", "path"):
        twice = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("_key")).where("n > 1")
        out = out.unionByName(twice.select(F.lit(f"duplicate_{column}").alias("rule"), F.col("_key").alias("key"), F.col("n").cast("string").alias("detail")))
    if inventory is not None:
        absent = df.join(inventory.select("path").distinct(), "path", "left_anti")
        out = out.unionByName(absent.select(F.lit("path_absent").alias("rule"), "key", F.col("path").alias("detail")))
    return out


def filter_samples(
    df: DataFrame, tags: Iterable[str] | None = None, max_frames: int | None = None, max_chars: int | None = None, allow_empty: bool = False,
) -> DataFrame:
    """Samples with a transcript (or ``allow_empty``), a wanted tag and lengths below the bounds; nulls decide as false."""
    text = F.col("transcription")
    keep = F.lit(True) if allow_empty else F.coalesce(text != "", F.lit(False))
    if tags is not None:
        keep = keep & F.coalesce(F.col("language_tag").isin(*tags), F.lit(False))
    if max_frames is not None:
        keep = keep & F.coalesce(F.col("num_frames") < max_frames, F.lit(False))
    if max_chars is not None:
        keep = keep & (text.isNull() | (F.length(text) < max_chars))
    return df.where(keep)


def filter_by_set(df: DataFrame, sets: DataFrame, tags: Iterable[str]) -> DataFrame:
    """Filter rows by the rules of their ``set_name``: a set with ``ignore_tags`` skips tag and transcript checks.

    ``sets`` has a row per evaluation set and is broadcast.
    """
    rules = F.broadcast(sets.select("set_name", "ignore_tags"))
    strict = F.coalesce(F.col("transcription") != "", F.lit(False)) & F.coalesce(F.col("language_tag").isin(*tags), F.lit(False))
    return df.join(rules, "set_name").where(F.col("ignore_tags") | strict).drop("ignore_tags")


def length_band(df: DataFrame, length_col: str, budget: int, min_len: int = 0, max_len: int | None = None) -> DataFrame:
    top = budget if max_len is None else max_len
    if not 0 <= min_len <= top <= budget:
        raise ValueError("0 <= min_len <= max_len <= budget is required")
    return df.where(F.col(length_col).between(min_len, top))


def filter_by_trials(df: DataFrame, trials: DataFrame) -> DataFrame:
    """Utterances on either side of a trial."""
    sides = trials.select(F.col("left").alias("key")).unionByName(trials.select(F.col("right").alias("key"))).distinct()
    return df.join(sides, "key", "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the table's columns, and the ids that do not match exactly one row (id, matches)."""
    counts = table.groupBy(on).agg(F.count(F.lit(1)).alias("matches"))
    bad = df.select(on).distinct().join(counts, on, "left").withColumn("matches", F.coalesce("matches", F.lit(0))).where("matches <> 1")
    return df.join(table, on), bad


def attach_transcripts(df: DataFrame, transcripts: DataFrame, enforce_vocab: bool = False) -> tuple[DataFrame, DataFrame]:
    """``df`` with text and language of ``transcripts`` (key, text, language), and its keys that have none."""
    text = F.col("text")
    joined = df.drop("transcription", "language_tag").join(
        transcripts.select("key", single_spaced(english_letters(text) if enforce_vocab else text).alias("transcription"), F.col("language").alias("language_tag")), "key", "left"
    )
    return joined, joined.where(F.col("transcription").isNull()).select("key")


def disjoint(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Values that both have; empty where the two are disjoint."""
    return a.select(on).intersect(b.select(on))


def union_manifests(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_transcripts(*maps: DataFrame) -> DataFrame:
    """Union of transcript tables (key, text, language); of equal keys the last table's row stays."""
    tagged = [m.select("key", "text", "language", F.lit(i).alias("_i")) for i, m in enumerate(maps)]
    both = union_manifests(*tagged)
    best = F.max_by(F.struct("text", "language"), F.struct("_i", "text"))
    return both.groupBy("key").agg(best.alias("b")).select("key", "b.text", "b.language")


def cached_enrichment(df: DataFrame, cache: DataFrame, compute, key: str = "key") -> DataFrame:
    """Cached rows of ``df``'s keys plus ``compute`` applied to the rest; both have the cache's columns."""
    hit = cache.join(df.select(key).distinct(), key, "left_semi")
    new = compute(df.join(cache.select(key), key, "left_anti")).select(*cache.columns)
    return hit.unionByName(new)


def checksum_status(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``name, status`` (ok, differs, missing, unexpected) of files (name, content) against expected (name, md5)."""
    got = files.select("name", F.md5("content").alias("_got"))
    both = expected.select("name", "md5").join(got, "name", "full")
    status = F.when(F.col("_got").isNull(), "missing").when(F.col("md5").isNull(), "unexpected").when(F.col("_got") == F.lower("md5"), "ok").otherwise("differs")
    return both.select("name", status.alias("status"))
