"""Character vocabularies, distributions, label maps and their joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import speaker_number
from ..functions.text import encode
from ..materialize import saved
from ..schemas import BLANK, SPECIAL_TOKENS
from .documents import Section, document
from .ordering import prefix


#: Bytes of text whose characters are counted at once.
CHARACTER_BYTES = 4 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).cast(pa.large_string()).drop_null()
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        counts, first = np.zeros(0x110000, np.int64), 0
        while first < len(texts):
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHARACTER_BYTES, "right")) - 1)
            text = str(memoryview(texts.buffers()[2])[offsets[first] : offsets[end]] if texts.buffers()[2] else b"", "utf-8")
            counts += np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32), minlength=len(counts))
            first = end
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in found.tolist()], pa.string()), pa.array(counts[found])], ["char", "n"])


def characters(df: DataFrame) -> DataFrame:
    """``char, n``: how often each batch of transcripts has each of its characters.

    A count over code points in Arrow batches; a batch gives a row per distinct character,
    where splitting texts would give one per character and text.
    """
    return df.select("transcription").mapInArrow(_counted, "char string, n bigint")


def _specials(df: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("idx"), F.lit(c).alias("char")) for i, c in enumerate(SPECIAL_TOKENS)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("s")).select("s.*")


def char_vocab(df: DataFrame) -> DataFrame:
    """``idx, char``: special tokens, then the distinct characters but the blank by code point."""
    found = characters(df).where("char <> ' '").select("char").distinct()
    numbered = prefix(found, [F.col("char")]).select((F.col("idx") + len(SPECIAL_TOKENS)).alias("idx"), "char")
    return _specials(df).unionByName(numbered)


def char_distribution(df: DataFrame) -> DataFrame:
    """``char, freq``: shares of all characters; the blank's share is the delimiter's, other special tokens have 0."""
    counts = characters(df).groupBy(F.when(F.col("char") == " ", "|").otherwise(F.col("char")).alias("char")).agg(F.sum("n").alias("n"))
    counts = saved(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    absent = _specials(df).select("char", F.lit(0).cast("bigint").alias("n")).join(counts.select("char"), "char", "left_anti")
    return counts.unionByName(absent).select("char", (F.col("n") / F.lit(float(total or 1))).alias("freq"))


def speaker_map(df: DataFrame) -> DataFrame:
    """``idx, speaker_id, gender, n_genders``: speakers by number, then text; more than one gender shows in n_genders."""
    one = df.where(F.col("speaker_id").isNotNull()).groupBy("speaker_id").agg(F.min("gender").alias("gender"), F.count_distinct("gender").alias("n_genders"))
    return prefix(one, [speaker_number(F.col("speaker_id")).asc_nulls_last(), F.col("speaker_id")]).select("idx", "speaker_id", "gender", "n_genders")


def attach_label(df: DataFrame, labels: DataFrame, on: str, idx: str = "idx", name: str = "label") -> tuple[DataFrame, DataFrame]:
    """``df`` with the index of its value as ``name``, and the values that have none."""
    joined = df.join(labels.select(on, F.col(idx).alias(name)), on, "left")
    return joined.where(F.col(name).isNotNull()), joined.where(F.col(name).isNull()).select(on).distinct()


def char_index(vocab: DataFrame) -> dict[str, int]:
    """Character to index on the driver; a vocabulary holds the characters of a writing system, at most all code points."""
    return {r["char"]: int(r["idx"]) for r in vocab.select("char", "idx").collect()}


def encode_with(text: Column, index: dict[str, int]) -> Column:
    return encode(text, F.map_from_arrays(F.array(*[F.lit(c) for c in index]), F.array(*[F.lit(int(i)) for i in index.values()])))


def class_prior(vocab: DataFrame, distribution: DataFrame, blank_value: float | None = None) -> tuple[DataFrame, DataFrame]:
    """One row ``prior`` (array in index order), and characters that only one side has."""
    joined = vocab.join(distribution, "char", "full")
    missing = joined.where(F.col("idx").isNull() | F.col("freq").isNull()).select("char")
    freq = F.col("freq") if blank_value is None else F.when(F.col("idx") == BLANK, F.lit(blank_value)).otherwise(F.col("freq"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", freq.alias("freq"))))
    return joined.agg(F.transform(ordered, lambda s: s["freq"]).alias("prior")), missing


def vocabulary_document(vocab: DataFrame) -> DataFrame:
    """Pieces of the document with characters, char_to_idx and idx_to_char."""
    char, idx = F.col("char"), F.col("idx")
    return document([Section("characters", vocab, "idx", char), Section("char_to_idx", vocab, "idx", idx, key=char), Section("idx_to_char", vocab, "idx", char, key=idx)])


def speaker_map_document(speakers: DataFrame) -> DataFrame:
    """Pieces of the document with speakers, speaker_to_idx, idx_to_speaker and gender, which leaves out speakers without one."""
    speaker, idx, known = F.col("speaker_id"), F.col("idx"), speakers.where(F.col("gender").isNotNull())
    return document([
        Section("speakers", speakers, "idx", speaker), Section("speaker_to_idx", speakers, "idx", idx, key=speaker),
        Section("idx_to_speaker", speakers, "idx", speaker, key=idx), Section("gender", known, "idx", F.col("gender"), key=speaker),
    ])


def speaker_map_json(speakers: DataFrame) -> DataFrame:
    """``value``: a JSON line with idx, speaker_id and gender for every speaker."""
    return speakers.select(F.to_json(F.struct("idx", "speaker_id", "gender")).alias("value"))


def distribution_json(distribution: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("char", "freq")))
    return distribution.agg(F.to_json(F.map_from_entries(rows)).alias("value"))
