"""Readers and writers of text formats: manifests, metadata, transcripts, markup, trials, plans."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import padded_id
from ..operators.trials import trial_line
from ..schemas import MANIFEST, SHARD_PLAN, TRANSCRIPTS
from .storage import Storage, opened, opens, place_files
from .wav import wav_header

#: What the reader of tables gives for ``""``, which it would take for null else.
_EMPTY = "\0"
_TSV = {"sep": "\t", "quote": '"', "escape": "\\", "header": True}


def _segment(i: int, path: Column | None = None) -> Column:
    """The i-th part of a file's path, counted from its end."""
    return F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -i)


def _matching(df: DataFrame, pattern: str) -> Column:
    return F.regexp_extract("value", pattern, 1)


def read_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """One or several manifests as one frame. A field without anything is null, a quoted one without anything the empty string."""
    lines = spark.read.schema(MANIFEST).options(**_TSV, emptyValue=_EMPTY).csv(list(paths))
    return lines.select(*[F.when(F.col(f.name) == _EMPTY, "").otherwise(F.col(f.name)).alias(f.name) if f.dataType == StringType() else f.name for f in MANIFEST])


def write_manifest(df: DataFrame, path: str) -> None:
    """Sorted by key over range partitions, so files follow each other in order."""
    df.select(*MANIFEST.names).orderBy("key").write.options(**_TSV).csv(path)


def write_plan(plan: DataFrame, path: str) -> None:
    plan.select("key", "shard_idx", "partial_shard").write.option("header", True).csv(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_PLAN).option("header", True).csv(path)


def read_trials(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Trials, and the lines that are none."""
    lines = spark.read.text(list(paths))
    ok = F.col("value").rlike("^[^ ]+ [^ ]+ [01]$")
    bits = F.split("value", " ")
    trials = lines.where(ok).select(F.get(bits, 0).alias("left"), F.get(bits, 1).alias("right"), (F.get(bits, 2) == "1").alias("same_speaker"))
    return trials, lines.where(~ok)


def write_trials(trials: DataFrame, path: str) -> None:
    trials.select(trial_line(trials).alias("value")).write.text(path)


def write_document(pieces: DataFrame, path: str) -> None:
    """One JSON file of the pieces (section, idx, value) of ``operators.documents``.

    Sorting is distributed; one task then streams the sorted pieces, a line each, into the file,
    which gets its name when it is whole.
    """
    staging = f"{path}._staging-{uuid.uuid4().hex}"
    storage = Storage(pieces.sparkSession, path)
    try:
        pieces.orderBy("section", "idx").select("value").coalesce(1).write.text(staging)
        storage.move(next(f for f in storage.files(staging) if f.rsplit("/", 1)[-1].startswith("part-")), path)
    finally:
        storage.remove(staging)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_librispeech_speakers(spark: SparkSession, path: str) -> DataFrame:
    """``id, sex, subset, minutes, name`` of the `` | `` separated table; comment lines begin with ``;``."""
    bits = F.split("value", r"\s+\|\s+", 5)
    lines = spark.read.text(path).where(~F.col("value").startswith(";") & (F.size(bits) == 5))
    return lines.select(
        F.trim(F.get(bits, 0)).cast("int").alias("id"), F.trim(F.get(bits, 1)).alias("sex"), F.trim(F.get(bits, 2)).alias("subset"),
        F.trim(F.get(bits, 3)).cast("double").alias("minutes"), F.trim(F.get(bits, 4)).alias("name"),
    )


def read_voxceleb_metadata(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    names = ("voxceleb_id", "vggface_id", "gender", "nationality", "set", "dataset")
    df = spark.read.schema(", ".join(f"{n} string" for n in names)).options(sep=sep, header=True, enforceSchema=True).csv(path)
    return df.select(*[F.trim(n).alias(n) for n in names])


# Columns of the telephone corpus's caller table, in file order.
CALLER_COLUMNS = (
    "id", "pin", "target", "sex", "birth_year", "dialect_area", "education", "ti", "payment_type", "amt_pd", "con", "remarks", "calls_deleted", "speaker_partition",
)


def read_callers(spark: SparkSession, path: str) -> DataFrame:
    bits = F.split("value", r",\s+", len(CALLER_COLUMNS))
    lines = spark.read.text(path).where(F.size(bits) == len(CALLER_COLUMNS))
    return lines.select(*[F.trim(F.translate(F.get(bits, i), '"', "")).alias(n) for i, n in enumerate(CALLER_COLUMNS)])


def read_utterance_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``utterance_id, text`` of ``*-*.trans.txt`` files, lower-cased."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*-*.trans.txt").text(path).where("trim(value) <> ''")
    return lines.select(F.substring_index("value", " ", 1).alias("utterance_id"), F.lower(F.regexp_extract("value", r"^\S+ ?(.*)$", 1)).alias("text"))


def read_session_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``speaker, session, utterance, text`` of ``speaker/session/transcript.txt``."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "transcript.txt").text(path)
    rows = lines.select(_segment(3).alias("speaker"), _segment(2).alias("session"), F.split("value", "\t", 2).alias("b")).where(F.size("b") == 2)
    return rows.select("speaker", "session", F.get("b", 0).alias("utterance"), F.get("b", 1).alias("text"))


def read_single_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``recording, channel, utterance, text``: one text file per utterance under ``recording/channel``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(
        _segment(3).alias("recording"), _segment(2).alias("channel"), F.regexp_replace(_segment(1), r"\.txt$", "").alias("utterance"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"),
    ).withColumn("speaker_id", F.concat(F.lit("hub5/"), F.concat_ws("_", F.lit("hub5"), "recording", "channel")))


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, line_no, value`` of markup files, a row per line in order; a file is one call."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.mrk").text(path, wholetext=True)
    lines = files.select(F.regexp_replace(_segment(1), r"\.mrk$", "").alias("file_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return lines.where(F.length(F.trim("value")) >= 2)


def read_reference_segments(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, start_s, end_s, channel, text`` of ``12.30 15.90 A: text`` lines, split at the first colon."""
    line = r"^\s*(\d+\.\d+)\s+(\d+\.\d+)\s+([AB])\d*:(.+)$"
    lines = spark.read.text(path).select(F.regexp_replace(_segment(1), r"\.[^.]*$", "").alias("file_id"), "value").where(F.col("value").rlike(line))
    group = lambda i: F.regexp_extract("value", line, i)
    return lines.select("file_id", group(1).cast("double").alias("start_s"), group(2).cast("double").alias("end_s"), group(3).alias("channel"), F.trim(group(4)).alias("text"))


def read_id_list(spark: SparkSession, path: str, name: str = "file_id") -> DataFrame:
    lines = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return lines.select(F.trim("value").try_cast("int").alias(name)).where(F.col(name).isNotNull()).distinct()


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """``key, text, language`` of documents that map keys to them."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TRANSCRIPTS)).alias("key", "t"))
    return docs.select("key", "t.text", "t.language")


def read_audio_inventory(spark: SparkSession, path: str, speakers: DataFrame | None = None) -> DataFrame:
    """``speaker, recording, utterance, path, num_frames, sample_rate, channels`` of ``speaker/recording/*.wav``.

    Figures come from the chunk headers; the samples are not read. Files of speakers that are
    not listed are not opened.
    """
    whole = not opens(path)  # a file system that only Spark opens gives contents as a whole
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    files = files.select("path", "length", _segment(3, F.col("path")).alias("speaker"), *(["content"] if whole else []))
    if speakers is not None:
        files = files.join(speakers.select("speaker").distinct(), "speaker", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length, *content in zip(*(c.to_pylist() for c in batch.columns)):
                with io.BytesIO(content[0]) if whole else opened(name) as file:
                    rows.append(wav_header(file, length))
            figures = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *figures], ["path", "num_frames", "sample_rate", "channels"])

    parsed = files.select("path", "length", *(["content"] if whole else [])).mapInArrow(run, "path string, num_frames long, sample_rate int, channels int")
    at = F.col("path")
    return parsed.select(_segment(3, at).alias("speaker"), _segment(2, at).alias("recording"), F.regexp_replace(_segment(1, at), r"\.wav$", "").alias("utterance"), "path", "num_frames", "sample_rate", "channels")


def write_named_text(df: DataFrame, path: str) -> None:
    """A text file below ``path`` for each ``file``, a relative name, with the lines ``value`` in the order of ``at``.

    Files get their names when all are written. Tasks stream them by Arrow's file systems; on one that only Spark has, its
    writer places the lines. Files cost more than their bytes, so small partitions are not merged.
    """
    spark = df.sparkSession
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "at")
    storage = Storage(spark, path)
    staging = storage.staging(path)
    try:
        if opens(path):
            pieces = dealt.select("file", F.encode(F.concat(F.coalesce("value", F.lit("")), F.lit("\n")), "UTF-8"))
            n = pieces.mapInArrow(lambda batches: place_files(batches, f"{staging}/out"), "n long").agg(F.sum("n")).first()[0]
            if n:
                storage.settle(f"{staging}/out", path)
        else:
            dealt.select("file", "value").write.partitionBy("file").text(staging)
            storage.name_parts(staging, path, "/file=([^/]*)", lambda m: unquote(m[1]))
    finally:
        storage.remove(staging)


def read_call_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file_id, speaker_a, speaker_b`` of call headers ``FILENAME: f_a_b``, and the files whose header is bad.

    A stray b goes from the first speaker and a letter l is read as 1; all ids have four
    characters.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lower(F.substring_index("value", "\n", 1)).alias("h"))
    bits = F.split(F.trim(F.regexp_extract("h", r"^filename:\s*(.*)$", 1)), "_")
    out = files.select(
        "path", F.regexp_replace(F.get(bits, 0), r"^sw", "").alias("file_id"), F.translate(F.translate(F.get(bits, 1), "b", ""), "l", "1").alias("speaker_a"),
        F.translate(F.get(bits, 2), "l", "1").alias("speaker_b"),
    )
    ok = F.coalesce((F.length("file_id") == 4) & (F.length("speaker_a") == 4) & (F.length("speaker_b") == 4), F.lit(False))
    return out.where(ok).drop("path"), out.where(~ok).select("path")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("eer double, weights string, layer int").options(sep=";", header=True).csv(path)


def shard_files(spark: SparkSession, *paths: str, pattern: str = "*.tar*", allow_partial: bool = False) -> DataFrame:
    """Distinct ``path`` of shard files under directories; partial ones only on request. None at all is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(paths)).select("path").distinct()
    out = files if allow_partial else files.where(~F.col("path").contains(".partial"))
    if out.isEmpty():
        raise ValueError(f"no shard matches {pattern} under {paths}")
    return out


def utterance_path(n: Column) -> Column:
    return F.concat(padded_id(n, 6), F.lit(".wav"))
