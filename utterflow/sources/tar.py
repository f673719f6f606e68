"""Tar shards of ``<i>/<key>.wav`` and ``<i>/<key>.json``: a Spark data source and sink.

Reading is a data source with a partition per shard. A task streams the members of its
shard from the file system in batches of bounded size; filters on key and speaker are
pushed into it, and it passes over the bytes of members that they leave out. So memory
follows the largest sample, never the shard.

Writing turns the samples of a shard into stretches of the tar format, which the task streams
into a hidden file; shards get their names when the job has ended, and attempts that fail
leave nothing. On a file system that only Spark opens, Spark's text writer places the
stretches; its line separator is a global header without entries, which readers of tar ignore.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.keys import speaker_of
from ..schemas import DATASETS, SHARD_META
from .storage import Storage, matching, opened, opens, place_files
from .wav import wav_file as wav_bytes

#: A batch ends at so many samples or bytes; a stretch of a shard that is written has about as many bytes.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
BLOCK = tarfile.BLOCKSIZE

_KEYS = [re.compile(rf"({d}/\w+/\w+/\w+)", re.ASCII) for d in DATASETS]


def wav_samples(data: bytes) -> np.ndarray:
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"data":
            return np.frombuffer(data[at + 8 : at + 8 + size], "<i2").astype(np.float32) / 32767
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


# --- reading

def key_of(stem: str) -> str | None:
    """The first key in a member's name, corpora tried in order."""
    return next((m[1] for m in (k.search(stem) for k in _KEYS) if m), None)


class Wanted:
    """Keys and speakers that filters ask for; None asks for all."""

    def __init__(self, keys: frozenset[str] | None = None, speakers: frozenset[str] | None = None):
        self.keys, self.speakers = keys, speakers

    def narrowed(self, column: str, values: frozenset[str]) -> Wanted:
        both = lambda old: values if old is None else old & values
        return Wanted(both(self.keys), self.speakers) if column == "key" else Wanted(self.keys, both(self.speakers))

    def has(self, stem: str) -> bool:
        """Whether to read a member. A speaker can be told by a key alone, so a name without one is an error then."""
        if self.keys is None and self.speakers is None:
            return True
        key = key_of(stem)
        if key is None and self.speakers is not None:
            raise ValueError(f"no key in the member name {stem}")
        key = key or re.sub(r"^\d+/", "", stem)
        return (self.keys is None or key in self.keys) and (self.speakers is None or "/".join(key.split("/")[:2]) in self.speakers)


def pairs(file: BinaryIO, wanted: Wanted, audio: bool = True) -> Iterator[tuple[str, bytes | None, str]]:
    """(stem, wav, json) of a shard's samples, in order; the bytes of other members are passed over, and of all wavs unless ``audio``."""
    pending: dict[str, dict[str, bytes | None]] = {}
    compressed = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    with tarfile.open(fileobj=file, mode="r|gz" if compressed else "r:") as tar:
        for m in tar:
            tar.members = []  # else it keeps all headers
            stem, dot, end = m.name.rpartition(".")
            if not m.isfile() or not dot or end not in ("wav", "json") or not wanted.has(stem):
                continue
            pair = pending.setdefault(stem, {})
            pair[end] = tar.extractfile(m).read() if audio or end == "json" else None
            if len(pair) == 2:
                pending.pop(stem)
                yield stem, pair["wav"], pair["json"].decode()
    if pending:
        raise ValueError(f"members without partner: {sorted(pending)[:3]}")


def batches_of(file: BinaryIO, shard: str, wanted: Wanted, audio: bool) -> Iterator[pa.RecordBatch]:
    """The samples of a shard as batches of bounded size."""
    rows, size = [], 0
    for stem, wav, meta in pairs(file, wanted, audio):
        key = key_of(stem) or re.sub(r"^\d+/", "", stem)
        rows.append((key, "/".join(key.split("/")[:2]), shard, wav, meta))
        size += len(wav or b"") + len(meta)
        if len(rows) == BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["key", "speaker", "shard", "wav", "meta"])


class ShardPartition(InputPartition):
    """One shard."""


class ShardReader(DataSourceReader):
    """A partition per shard, and the filters on key and speaker that it takes over."""

    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.pattern = options.get("pattern", "*.tar*")
        self.partial = options.get("allow_partial", "false").lower() == "true"
        self.audio = options.get("audio", "true").lower() == "true"
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("key",), ("speaker",)):
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted = self.wanted.narrowed(f.attribute[0], frozenset(values))
            else:
                yield f

    def partitions(self) -> list[ShardPartition]:
        found = dict(f for path in self.paths for f in matching(path, self.pattern))
        shards = sorted(path for path in found if self.partial or ".partial" not in path.rsplit("/", 1)[-1])
        if not shards:
            raise ValueError(f"no shard matches {self.pattern} under {self.paths}")
        return [ShardPartition(path) for path in shards]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        with opened(partition.value) as file:
            yield from batches_of(file, partition.value, self.wanted, self.audio)


class TarShards(DataSource):
    """``spark.read.format("tar_shards")``: options paths (a JSON list), pattern, allow_partial, audio."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return "key string, speaker string, shard string, wav binary, meta string"

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options)


def scan_shards(spark: SparkSession, *paths: str, pattern: str = "*.tar*", allow_partial: bool = False, audio: bool = True) -> DataFrame:
    """``key, speaker, shard, wav, meta`` of every sample; equality and IN on key and speaker are pushed into the scan."""
    if all(opens(p) for p in paths):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(TarShards)
        options = {"paths": json.dumps(list(paths)), "pattern": pattern, "allow_partial": str(allow_partial), "audio": str(audio)}
        return spark.read.format("tar_shards").options(**options).load()
    # a file system that only Spark opens: its reader gives a shard as one value, of at most 2 GB
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(paths)).select("path", "content")
    files = files if allow_partial else files.where(~F.col("path").contains(".partial"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from batches_of(io.BytesIO(content.as_buffer()), path, Wanted(), audio)

    return files.mapInArrow(run, TarShards({}).schema())


def read_shards(
    spark: SparkSession, *paths: str, pattern: str = "*.tar*", allow_partial: bool = False, speakers: Iterable[str] | None = None, decode: bool = False,
) -> DataFrame:
    """``key, shard, wav`` and the metadata of every sample; ``samples`` too with ``decode``. With ``speakers``, other members are not read."""
    raw = scan_shards(spark, *paths, pattern=pattern, allow_partial=allow_partial)
    if speakers is not None:
        raw = raw.where(F.col("speaker").isin(*speakers))
    out = raw.select("key", "shard", "wav", F.from_json("meta", SHARD_META).alias("m")).select("key", "shard", "wav", "m.*")
    if not decode:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = pa.array([None if w is None else wav_samples(w) for w in batch.column("wav").to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, samples], [*batch.schema.names, "samples"])

    return out.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in out.schema), "samples array<float>"]))


def of_speakers(df: DataFrame, speakers: DataFrame) -> DataFrame:
    """Samples whose key's speaker is in a table, of any size; a list is better given to ``read_shards``."""
    return df.join(speakers.select(F.col("speaker_id").alias("_s")).distinct(), speaker_of(F.col("key")) == F.col("_s"), "left_semi")


# --- writing

def _filler() -> bytes:
    """A global header without entries: one block that readers pass over."""
    info = tarfile.TarInfo("filler")
    info.type = tarfile.XGLTYPE
    return info.tobuf(tarfile.USTAR_FORMAT, "ascii", "strict")


def member_bytes(name: str, content: bytes) -> bytes:
    """Header and content of a member, in whole blocks."""
    info = tarfile.TarInfo(name)
    info.size = len(content)
    return info.tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape") + content + bytes(-len(content) % BLOCK)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard_idx, partial_shard, number, bytes`` of (shard_idx, partial_shard, member, wav, meta), sorted by shard and place."""
    shard, number, parts, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        values = [pa.array([shard[0]], pa.int64()), pa.array([shard[1]]), pa.array([number], pa.int64()), pa.array([b"".join(parts)], pa.binary())]
        return pa.RecordBatch.from_arrays(values, ["shard_idx", "partial_shard", "number", "bytes"])

    for batch in batches:
        for idx, partial, member, wav, meta in zip(*(c.to_pylist() for c in batch.columns)):
            if (idx, partial) != shard:
                if shard is not None:
                    parts.append(bytes(2 * BLOCK))  # the end of an archive
                    yield out()
                shard, number, parts, size = (idx, partial), 0, [], 0
            elif size >= BATCH_BYTES:
                yield out()
                number, parts, size = number + 1, [], 0
            parts += [member_bytes(f"{member}.wav", wav or b""), member_bytes(f"{member}.json", meta.encode())]
            size += len(parts[-1]) + len(parts[-2])
    if shard is not None:
        parts.append(bytes(2 * BLOCK))
        yield out()


def write_shards(df: DataFrame, plan: DataFrame, path: str, prefix: str, compress: bool = False, seed: int = 1337) -> None:
    """One tar per shard of ``plan``, its samples (key, wav, metadata) in a seeded order, as ``{prefix}.{idx:06d}[.partial].tar``.

    Shards that are there already under the same name are replaced, one after the other, once
    all have been written; until then readers see none of them, and if the job fails, nothing stays.
    """
    spark = df.sparkSession
    order = Window.partitionBy("shard_idx").orderBy(F.md5(F.concat_ws("|", "key", F.lit(str(seed)))), "key")
    size = F.count(F.lit(1)).over(Window.partitionBy("shard_idx"))
    names = df.select("key").join(plan, "key").withColumn("_i", F.row_number().over(order) - 1).withColumn("_digits", F.length((size - 1).cast("string")))
    meta = F.to_json(F.struct("num_frames", "sample_rate", "gender", "transcription", "speaker_id", F.col("key").alias("sample_id"), "language_tag"))
    member = F.concat(F.expr("lpad(string(_i), _digits, '0')"), F.lit("/"), F.col("key"))
    rows = df.join(names, "key").select("shard_idx", "partial_shard", member.alias("member"), "wav", meta.alias("meta"), "_i")
    dealt = rows.repartition("shard_idx").sortWithinPartitions("shard_idx", "_i").drop("_i")
    storage = Storage(spark, path)
    staging = storage.staging(path)
    ending = ".tar.gz" if compress else ".tar"
    name = lambda idx, partial: f"{prefix}.{idx:06d}{'.partial' if partial else ''}{ending}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays([pa.array([name(s.column(0)[0].as_py(), s.column(1)[0].as_py())]), s.column(3)], ["file", "piece"]) for s in _stretches(batches))
        yield from place_files(named, f"{staging}/out", "gzip" if compress else None)

    try:
        if opens(path):
            n = dealt.mapInArrow(place, "n long").agg(F.sum("n")).first()[0]
            if n:
                storage.settle(f"{staging}/out", path)
            return
        stretches = dealt.mapInArrow(_stretches, "shard_idx long, partial_shard boolean, number long, bytes binary")
        placed = stretches.sortWithinPartitions("shard_idx", "partial_shard", "number").select("shard_idx", "partial_shard", F.col("bytes").cast("string").alias("value"))
        writer = placed.write.partitionBy("shard_idx", "partial_shard").option("lineSep", _filler().decode("ascii"))
        (writer.option("compression", "gzip") if compress else writer).text(staging)
        storage.name_parts(staging, path, r"/shard_idx=(\d+)/partial_shard=(\w+)", lambda m: name(int(m[1]), m[2] == "true"))
    finally:
        storage.remove(staging)


__all__ = ["TarShards", "member_bytes", "of_speakers", "pairs", "read_shards", "scan_shards", "wav_bytes", "wav_samples", "write_shards"]
