"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("num_frames", T.LongType(), False),
    T.StructField("sample_rate", T.IntegerType(), False),
    T.StructField("speaker_id", T.StringType()),
    T.StructField("recording_id", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("language_tag", T.StringType()),
    T.StructField("transcription", T.StringType()),
])
SHARD_PLAN = "key string, shard_idx bigint, partial_shard boolean"
SHARD_META = "num_frames bigint, sample_rate int, gender string, transcription string, speaker_id string, sample_id string, language_tag string"
TRIALS = "left string, right string, same_speaker boolean"
EMBEDDINGS = "sample_id string, embedding array<float>"
TRANSCRIPTS = "map<string,struct<text:string,language:string>>"

SAMPLE_RATE = 16_000

# Ids of the corpora that a key may begin with, in search order.
DATASETS = ("ls", "vc1", "vc2", "wsj", "cv", "cgn", "sw", "sre08", "hub5")
GENDERS = ("m", "f")
# Special tokens of the character vocabulary, in index order.
SPECIAL_TOKENS = ("<blank>", "<s>", "</s>", "<unk>", "|")
BLANK, START, END, UNKNOWN, DELIMITER = range(5)
