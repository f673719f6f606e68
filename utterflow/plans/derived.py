"""Speech tables derived from general tables by deterministic expressions, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import english_letters, single_spaced
from ..schemas import SAMPLE_RATE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest: a document is an utterance, its source the speaker, its id modulo 7 the recording."""
    d = table(spark, sf_dir, "documents")
    spk, rec = F.substring("source", 4, 10), (F.col("doc_id") % 7).cast("string")
    key = F.concat(F.lit("ls/"), spk, F.lit("/"), rec, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return d.select(
        key.alias("key"), F.concat(key, F.lit(".wav")).alias("path"), (F.col("n_chars") * 160).alias("num_frames"), F.lit(SAMPLE_RATE).alias("sample_rate"),
        F.concat(F.lit("ls/"), spk).alias("speaker_id"), F.concat(F.lit("ls/"), rec).alias("recording_id"),
        F.when(spk.cast("int") % 2 == 0, "m").otherwise("f").alias("gender"), F.col("lang").alias("language_tag"),
        single_spaced(english_letters(F.col("text"))).alias("transcription"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with keys: the label is the speaker, the id modulo 5 the session."""
    e = table(spark, sf_dir, "embeddings")
    key = F.concat(F.lit("vc1/id"), F.col("label").cast("string"), F.lit("/"), (F.col("vec_id") % 5).cast("string"), F.lit("/"), F.col("vec_id").cast("string"))
    return e.select(key.alias("sample_id"), "embedding", "label", "vec_id", F.when(F.col("label") % 2 == 0, "m").otherwise("f").alias("gender"))


def markup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call markup: a conversation is a call, the user and all others its channels, a turn a sentence, its words timed by place."""
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", F.when(F.col("role") == "user", "A").otherwise("B").alias("ch"), F.posexplode(F.split(single_spaced(F.col("text")), " ")).alias("i", "w"))
    start = F.col("turn") * 100 + F.col("i") * 0.5
    value = F.concat_ws(" ", F.concat_ws(".", "ch", F.col("turn").cast("string")), start.cast("string"), F.lit("0.5"), "w")
    return words.select(F.col("conv_id").alias("file_id"), (F.col("turn") * 100_000 + F.col("i")).alias("line_no"), value.alias("value"))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and hypothesis of whole transcripts.

    Words carry their place modulo 97, so that they match near their own place only. Of every 60
    words, the hypothesis has another word for the 11th, leaves out the 31st and has one
    more behind the 51st: each is one error, and no cheaper alignment is possible.
    """
    u = utterances(spark, sf_dir)
    words = F.when(F.col("transcription") == "", F.array().cast("array<string>")).otherwise(F.split("transcription", " "))
    placed = F.transform(words, lambda w, i: F.concat(w, (i % 97).cast("string")))
    other = lambda i: F.concat(F.lit("="), i.cast("string"))
    heard = F.transform("w", lambda w, i: F.when(i % 60 == 10, F.array(other(i))).when(i % 60 == 30, F.array().cast("array<string>")).when(i % 60 == 50, F.array(w, other(i))).otherwise(F.array(w)))
    return u.select("key", "language_tag", placed.alias("w")).select("key", "language_tag", F.array_join("w", " ").alias("ref"), F.array_join(F.flatten(heard), " ").alias("hyp"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry: an event is a logged value, its type the metric, its user the run."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"))
