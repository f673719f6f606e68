"""Structured Streaming over arriving manifests, shards and telemetry.

The file source sees each file once. State is bounded throughout: aggregates keep a row and a
sketch of fixed size per group, and keyed state goes when the watermark has passed it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.batching import Heap, Packing
from ..operators.vocab import characters
from ..schemas import MANIFEST
from ..sources.storage import opened
from ..sources.tar import TarShards, Wanted, batches_of

#: Ranks of the quantiles that a sketch of size SKETCH gives to about 1.4 percent of the rows.
QUANTILES, SKETCH = (0.1, 0.2, 0.8, 0.9), 200
#: Relative error of distinct counts.
DISTINCT_ERROR = 0.01
#: Spark's setting for the most tasks that list files.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def manifest_stream(spark: SparkSession, path: str, schema: StructType = MANIFEST, fmt: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    for name, value in (("maxFilesPerTrigger", files_per_trigger), ("pathGlobFilter", glob)):
        reader = reader.option(name, value) if value is not None else reader
    return reader.load(path)


def shard_stream(spark: SparkSession, path: str, pattern: str = "*.tar*", allow_partial: bool = False, speakers: frozenset[str] | None = None, shards_per_trigger: int | None = None) -> DataFrame:
    """``key, speaker, shard, wav, meta`` of the samples of arriving shards.

    The stream carries the shards' names; a task streams the members of its shards from the
    file system, so no shard is held as a whole.
    """
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", pattern)
    reader = reader if shards_per_trigger is None else reader.option("maxFilesPerTrigger", shards_per_trigger)
    names = reader.load(path).select("path")
    names = names if allow_partial else names.where(~F.col("path").contains(".partial"))
    wanted = Wanted(speakers=speakers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    yield from batches_of(file, name, wanted, True)

    return names.mapInArrow(run, TarShards({}).schema())


def _sketched(column: str, name: str) -> list:
    values = F.col(column).cast("long")
    sketch = F.kll_sketch_agg_bigint(values, F.lit(SKETCH))
    return [F.min(values).alias(f"{name}_min"), F.max(values).alias(f"{name}_max"), F.avg(values).alias(f"{name}_avg"), sketch.alias(f"_{name}")]


def running_stats(samples: DataFrame, by: str = "language_tag") -> DataFrame:
    """One running row per group: what ``stats.corpus_stats`` counts of samples, speakers, sessions, frames and transcripts.

    Counts, sums, extremes and means are exact. Quantiles come from mergeable sketches of
    fixed size, and distinct speakers and sessions from sketches too, so state does not
    grow with the rows.
    """
    text = samples.withColumns({"_text": F.length("transcription"), "_session": F.concat_ws("/", "speaker_id", "recording_id")})
    rows = text.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("gender") == "m").alias("samples_m"), F.count_if(F.col("gender") == "f").alias("samples_f"),
        F.approx_count_distinct("speaker_id", DISTINCT_ERROR).alias("speakers"), F.approx_count_distinct("_session", DISTINCT_ERROR).alias("speaker_sessions"),
        F.sum("num_frames").alias("frames_total"), *_sketched("num_frames", "frames"), F.sum("_text").cast("long").alias("transcript_total"), *_sketched("_text", "transcript"),
    )
    ranks = lambda name: [F.kll_sketch_get_quantile_bigint(f"_{name}", F.lit(q)).alias(f"{name}_q{round(100 * q)}") for q in QUANTILES]
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], *ranks("frames"), *ranks("transcript"))


def running_characters(samples: DataFrame) -> DataFrame:
    """``char, n``: counted per transcript first, so a character is one row of each."""
    return characters(samples).groupBy("char").agg(F.sum("n").alias("n"))


def first_of_key(samples: DataFrame, arrival: str, key: str = "key", delay: str = "1 hour") -> DataFrame:
    """The first sample of each key, at once; keys are forgotten ``delay`` behind the watermark."""
    return samples.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([key])


def arrivals_of_key(samples: DataFrame, arrival: str, key: str = "key", gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``key, first_seen, last_seen, n, duplicates`` of each key, when no copy of it has come for ``gap``.

    Arrivals of a key at most ``gap`` apart are one session, whose first row counts and whose
    other rows are duplicates. The state is a row per key that is still open.
    """
    session = F.session_window(arrival, gap)
    counted = samples.withWatermark(arrival, delay).groupBy(session, key).agg(F.min(arrival).alias("first_seen"), F.max(arrival).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return counted.select(key, "first_seen", "last_seen", "n", (F.col("n") - 1).alias("duplicates"))


def windowed_means(events: DataFrame, time: str, width: str = "1 hour", delay: str = "10 minutes", by: str = "metric") -> DataFrame:
    """Mean and count of ``value`` per tumbling window and metric; late rows beyond ``delay`` are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.avg("value").alias("mean"), F.count("value").alias("n")).select(
        F.col("window.start").alias("start"), by, "mean", "n"
    )


class Packer(StatefulProcessor):
    """The fold of ``batching.pack`` over the samples of a shard as they arrive.

    State is the heap of at most ``buffer`` samples and the counters of the open batch; a
    sample is emitted with its batch when it leaves the heap. A row with a null key ends the
    shard; so does a timer, ``expiry_ms`` of event time behind the last arrival. Both empty
    the heap and the state.
    """

    def __init__(self, budget: int, buffer: int, padded: bool, min_len: int, max_len: int, expiry_ms: int):
        self.budget, self.buffer, self.padded, self.min_len, self.max_len, self.expiry_ms = budget, buffer, padded, min_len, max_len, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "num_frames bigint, seq bigint, key string")
        self.counters = handle.getValueState("counters", "seq bigint, batch bigint, n bigint, total bigint, longest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, *counters = self.counters.get() if self.counters.exists() else (0, 0, 0, 0, 0)
        packing = Packing(self.budget, self.padded, *counters)
        heap = Heap(self.buffer, [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [])
        arrived = pd.concat(list(rows), ignore_index=True)
        latest = arrived["arrival"].max()
        out = []
        for name, frames in arrived.sort_values("key", kind="stable")[["key", "num_frames"]].dropna().itertuples(index=False):
            if self.min_len <= frames <= self.max_len:
                left = heap.push((int(frames), seq, name))
                seq += 1
                if left:
                    out.append((left[2], *packing.add(left[0])))
        if arrived["key"].isna().any():
            out += [(name, *packing.add(frames)) for frames, _, name in heap.rest()]
            self._forget()
        else:
            self.waiting.put(heap.items)
            self.counters.update((seq, packing.batch, packing.n, packing.total, packing.longest))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(latest.timestamp() * 1000) + self.expiry_ms)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counters.exists():
            packing = Packing(self.budget, self.padded, *self.counters.get()[1:])
            heap = Heap(self.buffer, [tuple(r) for r in self.waiting.get()])
            out = [(name, *packing.add(frames)) for frames, _, name in heap.rest()]
            self.waiting.clear()
            self.counters.clear()
            if out:
                yield self._frame(key, out)

    def _forget(self) -> None:
        self.waiting.clear()
        self.counters.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _frame(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["shard_idx", "key", "batch_id", "place"])

    def close(self) -> None:
        pass


def packed_stream(samples: DataFrame, budget: int, buffer: int = 1000, padded: bool = True, min_len: int = 0, max_len: int | None = None, delay: str = "10 minutes", expiry_s: int = 3600) -> DataFrame:
    """``shard_idx, key, batch_id, place`` of arriving samples (shard_idx, key, num_frames, arrival), as ``batching.batch_max_tokens`` gives them.

    Samples of a shard arrive in the order of their keys, or in that order within a trigger.
    Needs the RocksDB state store.
    """
    top = budget if max_len is None else max_len
    if not 0 <= min_len <= top <= budget or buffer <= 0:
        raise ValueError("0 <= min_len <= max_len <= budget and a positive buffer are required")
    rows = samples.select("shard_idx", "key", "num_frames", "arrival").withWatermark("arrival", delay)
    return rows.groupBy("shard_idx").transformWithStateInPandas(
        statefulProcessor=Packer(budget, buffer, padded, min_len, top, expiry_s * 1000), outputStructType="shard_idx bigint, key string, batch_id bigint, place bigint", outputMode="append", timeMode="EventTime"
    )


def enrich_stream(samples: DataFrame, cache_path: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "key") -> StreamingQuery:
    """Start a query that adds ``compute``'s rows of new keys to the Parquet table at ``cache_path``.

    Each batch of a query has a folder of its own, named after the checkpoint and the batch. A
    batch that runs again overwrites it with the same rows, and a query that starts over
    finds all keys and adds none.
    """
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        kinds = compute(rows.limit(0)).schema
        # an empty folder first, so that the table can always be read
        spark.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{cache_path}/run={run}/batch={number}")
        known = spark.read.schema(kinds).parquet(cache_path).select(key).distinct()
        compute(rows.join(known, key, "left_anti")).write.mode("append").parquet(f"{cache_path}/run={run}/batch={number}")

    return samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(stream: DataFrame, mode: str, path: str, checkpoint: str) -> list[str]:
    """Run a stream over all files that are there now; the Parquet folders of its result under ``path``.

    In complete mode only the last batch's folder is the result. A batch that runs again
    overwrites its folder.
    """
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:09d}")
        done.append(number)

    spark = stream.sparkSession
    listing = spark.conf.get(LISTING)
    # else each file of a batch of over 32 is listed by a task of its own
    spark.conf.set(LISTING, str(min(int(listing), spark.sparkContext.defaultParallelism)))
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(LISTING, listing)
    return [f"{path}/{number:09d}" for number in sorted(set(done))][-1 if mode == "complete" else 0 :]
