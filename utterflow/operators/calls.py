"""Telephone calls: markup to sentences to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import frame_span, span_in_audio
from ..functions.text import clean_sentence_id, padded_id
from ..schemas import SAMPLE_RATE

#: Calls of a list that is broadcast, at most: some megabytes of ids.
BROADCAST_CALLS = 200_000


def parse_markup(lines: DataFrame, reversed_ids: DataFrame | None = None) -> DataFrame:
    """Tokens ``file_id, line_no, sentence_no, channel, start_s, dur_s, token`` of markup lines (file_id, line_no, value).

    Lines with unreadable times, blank ids or bracketed tokens go. Files in
    ``reversed_ids`` (file_id) have their channels swapped.
    """
    bits = F.split(F.trim("value"), r"\s+")
    token = F.array_join(F.slice(bits, 4, F.greatest(F.size(bits) - 3, F.lit(0))), " ")
    ident = clean_sentence_id(F.get(bits, 0))
    out = lines.where((F.length(F.trim("value")) >= 2) & (F.size(bits) >= 4)).select(
        "file_id", "line_no", ident.alias("_id"), F.get(bits, 1).try_cast("double").alias("start_s"), F.get(bits, 2).try_cast("double").alias("dur_s"), token.alias("token")
    )
    out = out.where(F.col("start_s").isNotNull() & F.col("dur_s").isNotNull() & ~F.col("token").rlike(r"[\[\]]") & F.col("_id").rlike(r"^[AB]\.\d+$"))
    channel, number = F.substring("_id", 1, 1), F.substring_index("_id", ".", -1).cast("int")
    out = out.withColumns({"sentence_no": number, "channel": channel}).drop("_id")
    if reversed_ids is not None:
        out = swap_channels(out, reversed_ids)
    return out.select("file_id", "line_no", "sentence_no", "channel", "start_s", "dur_s", "token")


def _wrong(reversed_ids: DataFrame) -> DataFrame:
    """Listed calls as ``file_id, _wrong``, broadcast if they have been counted as few; longer lists are joined by Spark's own choice."""
    wrong = reversed_ids.select("file_id", F.lit(True).alias("_wrong")).distinct()
    return F.broadcast(wrong) if wrong.limit(BROADCAST_CALLS + 1).count() <= BROADCAST_CALLS else wrong


def swap_channels(df: DataFrame, reversed_ids: DataFrame) -> DataFrame:
    wrong = _wrong(reversed_ids)
    other = F.when(F.col("channel") == "A", "B").when(F.col("channel") == "B", "A").otherwise(F.col("channel"))
    return df.join(wrong, "file_id", "left").withColumn("channel", F.when(F.col("_wrong"), other).otherwise(F.col("channel"))).drop("_wrong")


def swap_speakers(calls: DataFrame, reversed_ids: DataFrame) -> DataFrame:
    """``calls`` (file_id, speaker_a, speaker_b) with the speakers of listed calls exchanged."""
    wrong = _wrong(reversed_ids)
    joined = calls.join(wrong, "file_id", "left")
    a, b = F.col("speaker_a"), F.col("speaker_b")
    return joined.select("file_id", F.when(F.col("_wrong"), b).otherwise(a).alias("speaker_a"), F.when(F.col("_wrong"), a).otherwise(b).alias("speaker_b"))


def assemble_sentences(tokens: DataFrame) -> DataFrame:
    """``file_id, channel, sentence_no, start_s, end_s, text``, grouped by channel and number."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "start_s", "dur_s", "token")))
    out = tokens.groupBy("file_id", "channel", "sentence_no").agg(rows.alias("r"))
    last = F.element_at("r", -1)
    return out.select(
        "file_id", "channel", "sentence_no", F.get("r", 0)["start_s"].alias("start_s"), (last["start_s"] + last["dur_s"]).alias("end_s"),
        F.array_join(F.transform("r", lambda s: s["token"]), " ").alias("text"),
    )


def by_duration(sentences: DataFrame, shortest: float = 3.0, longest: float = 20.0) -> DataFrame:
    return sentences.where((F.col("start_s") >= 0) & (F.col("end_s") - F.col("start_s")).between(shortest, longest))


def usable_text(text: Column) -> Column:
    """More than one word, and no hyphen left."""
    clean = F.trim(text)
    return F.coalesce(clean.contains(" ") & ~clean.contains("-"), F.lit(False))


def min_sessions(df: DataFrame, n: int = 2, speaker: str = "speaker_id", session: str = "recording_id") -> DataFrame:
    enough = df.select(speaker, session).distinct().groupBy(speaker).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(speaker)
    return df.join(enough, speaker, "left_semi")


def match_files(files: DataFrame, kinds: tuple[str, ...] = ("wav", "txt", "mrk")) -> DataFrame:
    """``file_id`` with a path per kind of files (file_id, kind, path); incomplete ids go."""
    wide = files.where(F.col("kind").isin(*kinds)).groupBy("file_id").pivot("kind", list(kinds)).agg(F.min("path"))
    return wide.dropna(subset=list(kinds))


def zip_stems(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``a`` and ``b`` (stem, path) by stem, and the stems that only one side has."""
    both = a.select("stem", F.col("path").alias("left_path")).join(b.select("stem", F.col("path").alias("right_path")), "stem", "full")
    alone = F.col("left_path").isNull() | F.col("right_path").isNull()
    return both.where(~alone), both.where(alone).select("stem")


def split_channels(recordings: DataFrame) -> DataFrame:
    """A row per channel of recordings (file_id, channels): ids end in -a, -b."""
    return recordings.select("file_id", F.posexplode("channels").alias("_c", "samples")).select(
        F.concat("file_id", F.lit("-"), F.get(F.array(F.lit("a"), F.lit("b")), F.col("_c"))).alias("file_id"), "samples"
    )


def segment_spans(sentences: DataFrame, recordings: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """Sentences with their frames in their recording (file_id, num_frames) and ``inside``."""
    framed = sentences.withColumn("_f", frame_span(F.col("start_s"), F.col("end_s"), rate)).select("*", "_f.start_frame", "_f.end_frame").drop("_f")
    return framed.join(recordings, "file_id").withColumn("inside", span_in_audio(F.col("start_frame"), F.col("end_frame"), F.col("num_frames")))


def segment(sentences: DataFrame, recordings: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """Samples of each sentence from recordings (file_id, channels); spans outside the audio go."""
    sized = recordings.select("file_id", "channels", F.size(F.get("channels", 0)).cast("bigint").alias("num_frames"))
    framed = segment_spans(sentences, sized, rate).where("inside")
    track = F.get("channels", F.when(F.col("channel") == "A", 0).otherwise(1))
    return framed.withColumn("samples", F.slice(track, (F.col("start_frame") + 1).cast("int"), (F.col("end_frame") - F.col("start_frame")).cast("int"))).drop("channels")


def utterance_name(n: Column) -> Column:
    return padded_id(n, 6)
