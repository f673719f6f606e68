"""Keys ``dataset/speaker/recording/utterance`` and the ids derived from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATASETS


def part(key: Column, i: int) -> Column:
    return F.get(F.split(key, "/"), i)


def dataset_of(key: Column) -> Column:
    return part(key, 0)


def speaker_of(key: Column) -> Column:
    """``dataset/speaker``."""
    return F.substring_index(key, "/", 2)


def session_of(key: Column) -> Column:
    """``dataset/speaker/recording``: a session never spans speakers or corpora."""
    return F.substring_index(key, "/", 3)


def decompose(df: DataFrame, key_col: str = "key") -> DataFrame:
    key = F.col(key_col)
    return df.withColumns({n: part(key, i) for i, n in enumerate(("dataset", "speaker", "recording", "utterance"))})


def make_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def find_key(text: Column, datasets: Iterable[str] = DATASETS) -> Column:
    """The first key in a path or text, datasets tried in order; null if there is none."""
    found = [F.nullif(F.regexp_extract(text, rf"({d}/\w+/\w+/\w+)", 1), F.lit("")) for d in datasets]
    return F.coalesce(*found)


def is_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^[^/]+/[^/]+/[^/]+/[^/]+$") & dataset_of(key).isin(*DATASETS), F.lit(False))


def is_speaker_id(speaker: Column, key: Column | None = None) -> Column:
    ok = speaker.rlike("^[^/]+/[^/]+$")
    return F.coalesce(ok if key is None else ok & is_key(key) & (speaker_of(key) == speaker), F.lit(False))


def is_recording_id(recording: Column, key: Column | None = None) -> Column:
    """Two segments that equal the key's dataset and recording."""
    ok = recording.rlike("^[^/]+/[^/]+$")
    return F.coalesce(ok if key is None else ok & is_key(key) & (make_key(part(key, 0), part(key, 2)) == recording), F.lit(False))


def speaker_number(speaker: Column) -> Column:
    """The number at the end of a speaker id; null where there is none, to sort by text then."""
    return F.nullif(F.regexp_extract(speaker, r"/(?:id)?(\d+)$", 1), F.lit("")).cast("bigint")


def gender_code(raw: Column) -> Column:
    """m or f from MALE, "female", M and the like; null for anything else."""
    clean = F.lower(F.trim(F.translate(raw, '"', "")))
    return F.when(clean.isin("m", "male"), "m").when(clean.isin("f", "female"), "f")


def standard_tag(tag: Column, aliases: DataFrame | None = None) -> Column:
    """Canonical case of a language tag: language lower, script title, region upper."""
    bits = F.split(F.translate(F.trim(tag), "_", "-"), "-")
    shaped = F.transform(bits, lambda b, i: F.when(i == 0, F.lower(b)).when(F.length(b) == 4, F.initcap(b)).when(F.length(b) == 2, F.upper(b)).otherwise(F.lower(b)))
    return F.array_join(shaped, "-")


def standardise_tags(df: DataFrame, aliases: DataFrame, col: str = "language_tag") -> DataFrame:
    """``df`` with canonical tags; ``aliases`` (tag, standard) folds macro-languages. The alias table is a registry, some thousands of rows at most."""
    known = aliases.select(F.lower("tag").alias("_tag"), F.col("standard").alias("_standard"))
    shaped = df.withColumn(col, standard_tag(F.col(col)))
    return shaped.join(F.broadcast(known), F.lower(F.col(col)) == F.col("_tag"), "left").withColumn(col, F.coalesce("_standard", col)).drop("_tag", "_standard")


def tidy_metadata(df: DataFrame, names: dict[str, str], dataset: str) -> DataFrame:
    """Columns renamed, all strings trimmed, and the dataset as a column."""
    out = df.withColumnsRenamed(names)
    trimmed = {f.name: F.trim(f.name) for f in out.schema if f.dataType.simpleString() == "string"}
    return out.withColumns(trimmed).withColumn("dataset", F.lit(dataset))
