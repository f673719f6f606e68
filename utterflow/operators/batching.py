"""Chunks and batches of samples."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import right_pad
from ..functions.text import none_if_null
from ..schemas import SAMPLE_RATE


def chunk(df: DataFrame, strategy: str, seconds: float = 2.0, rate: int = SAMPLE_RATE, seed: int = 0, epoch: int = 0, key: str = "key", samples: str = "samples") -> DataFrame:
    """``df`` with chunks of ``samples`` and their ``num_frames``; ``chunk_idx`` numbers the chunks of a row.

    start: the first frames; random: from a seeded place; contiguous: all whole chunks, the
    rest dropped; none: as they are. Shorter inputs stay whole, but contiguous drops them.
    """
    n = int(round(seconds * rate))
    x, size = F.col(samples), F.size(samples)
    if strategy == "none":
        out = df.withColumn("chunk_idx", F.lit(0))
    elif strategy == "start":
        out = df.withColumns({samples: F.slice(x, 1, n), "chunk_idx": F.lit(0)})
    elif strategy == "random":
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed)), F.lit(str(epoch)))), 1, 8), 16, 10).cast("bigint")
        start = F.when(size > n, F.pmod(draw, size - n + 1)).otherwise(0).cast("int")
        out = df.withColumns({samples: F.slice(x, start + 1, F.lit(n)), "chunk_idx": F.lit(0)})
    elif strategy == "contiguous":
        k = F.floor(size / n).cast("int")
        out = df.where(k > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), k - 1))).withColumn(samples, F.slice(x, F.col("chunk_idx") * n + 1, F.lit(n)))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return out.withColumn("num_frames", F.size(samples).cast("bigint"))


def _draw(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def buffer_shuffle(df: DataFrame, buffer: int, by: str = "shard_idx", order: Sequence[str] = ("key",), key: str = "key", seed: int = 0, epoch: int = 0) -> DataFrame:
    """``by, key, place``: the places of the rows of each ``by`` after a shuffle through a buffer of ``buffer`` keys.

    Keys stream past in ``order``; each one beyond the first ``buffer`` takes the slot of a drawn
    one, which goes out, and the buffer goes out in a seeded order at the end. So a key comes
    at most ``buffer`` places early and the memory is the buffer. Draws depend on the group,
    the seed, the epoch and the step alone. Only keys and order columns go through Python.
    """
    if buffer <= 0:
        raise ValueError("a positive buffer is required")
    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, key)}
    names = [by, key, *[c for c in order if c not in (by, key)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, step, out = None, [], 0, []

        def rest() -> None:
            nonlocal held
            held.sort(key=lambda k: (hashlib.md5(f"{k}|{epoch}|{seed}".encode()).hexdigest(), k))
            first = step - len(held)
            out.extend((group, k, first + n) for n, k in enumerate(held))
            held = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*types, pa.int64()))], [by, key, "place"])

        for batch in batches:
            types = batch.schema.field(0).type, batch.schema.field(1).type
            for g, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != group:
                    rest()
                    group, step = g, 0
                if len(held) < buffer:
                    held.append(k)
                else:
                    at = _draw(f"{g}|{epoch}|{seed}|{step}") % buffer
                    out.append((g, held[at], step - buffer))
                    held[at] = k
                step += 1
            if out:
                yield batch_of(out)
                out = []
        rest()
        if out:
            yield batch_of(out)

    rows = df.select(*names).repartition(by).sortWithinPartitions(by, *order)
    return rows.mapInArrow(run, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, place bigint")


def batch_fixed(df: DataFrame, n: int, drop_last: bool = False, by: str = "shard_idx", order: Sequence[str] = ("key",)) -> DataFrame:
    """``df`` with ``batch_id``: groups of ``n`` neighbours within each ``by``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    out = df.withColumn("batch_id", F.floor(rank / n).cast("bigint"))
    if drop_last:
        size = F.count(F.lit(1)).over(Window.partitionBy(by, "batch_id"))
        out = out.withColumn("_n", size).where(F.col("_n") == n).drop("_n")
    return out


class Heap:
    """A buffer from which the least item leaves when it is full."""

    def __init__(self, size: int, items: list | None = None):
        self.size, self.items = size, items or []
        heapq.heapify(self.items)

    def push(self, item: tuple) -> tuple | None:
        heapq.heappush(self.items, item)
        return heapq.heappop(self.items) if len(self.items) == self.size else None

    def rest(self) -> Iterator[tuple]:
        while self.items:
            yield heapq.heappop(self.items)


class Packing:
    """Counters of the open batch, which closes before it exceeds the budget."""

    def __init__(self, budget: int, padded: bool, batch: int = 0, n: int = 0, total: int = 0, longest: int = 0):
        self.budget, self.padded, self.batch, self.n, self.total, self.longest = budget, padded, batch, n, total, longest

    def add(self, length: int) -> tuple[int, int]:
        """Batch and place of the next sample."""
        longest = max(self.longest, length)
        cost = (self.n + 1) * longest if self.padded else self.total + length
        if cost > self.budget:
            self.batch, self.n, self.total, self.longest = self.batch + 1, 1, length, length
        else:
            self.n, self.total, self.longest = self.n + 1, cost, longest
        return self.batch, self.n - 1


def pack(lengths: list[int], budget: int, buffer: int, padded: bool) -> list[list[int]]:
    """Places of ``lengths`` in batches: the shortest of a buffer goes next, and a batch closes before it exceeds the budget."""
    heap, packing, batches = Heap(buffer), Packing(budget, padded), []

    def add(item: tuple[int, int]) -> None:
        _, place = packing.add(item[0])
        if not place:
            batches.append([])
        batches[-1].append(item[1])

    for i, length in enumerate(lengths):
        if left := heap.push((length, i)):
            add(left)
    for item in heap.rest():
        add(item)
    return batches


def batch_max_tokens(
    df: DataFrame, budget: int, length: str = "num_frames", min_len: int = 0, max_len: int | None = None, buffer: int = 1000, padded: bool = False,
    by: str = "shard_idx", order: Sequence[str] = ("key",), key: str = "key",
) -> DataFrame:
    """``by, key, batch_id, place``: samples of bounded length packed under a token budget, by shard.

    The fold is sequential within a shard, which has a bounded number of samples; shards
    run in parallel, and only keys and lengths go through Python.
    """
    top = budget if max_len is None else max_len
    if not 0 <= min_len <= top <= budget or buffer <= 0:
        raise ValueError("0 <= min_len <= max_len <= budget and a positive buffer are required")
    rows = df.where(F.col(length).between(min_len, top)).select(by, key, F.col(length).alias("_length"), *[c for c in order if c not in (by, key, length)])
    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, key)}

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([c if c != length else "_length" for c in order], kind="stable")
        places = [(i, b, k) for b, batch in enumerate(pack(group["_length"].tolist(), budget, buffer, padded)) for k, i in enumerate(batch)]
        out = group.iloc[[i for i, _, _ in places]][[by, key]].reset_index(drop=True)
        out["batch_id"], out["place"] = [b for _, b, _ in places], [k for _, _, k in places]
        return out

    return rows.groupBy(by).applyInPandas(fold, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, batch_id bigint, place bigint")


def collate(df: DataFrame, by: str = "shard_idx", batch: str = "batch_id", order: str = "key", samples: str = "samples", text: str | None = None, codes: str | None = None, label: str | None = None) -> DataFrame:
    """One row per batch: keys, samples padded to the longest, lengths, and transcripts, their codes and labels where named."""
    fields = [F.col(order).alias("o"), F.col("key").alias("k"), F.col(samples).alias("x")]
    fields += [none_if_null(F.col(text)).alias("t")] if text else []
    fields += [F.col(codes).alias("c")] if codes else []
    fields += [F.col(label).alias("l")] if label else []
    grouped = df.groupBy(by, batch).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"))
    each = lambda name: F.transform("r", lambda s: s[name])
    sized = lambda c: F.transform(c, lambda a: F.size(a).cast("bigint"))
    out = {"keys": each("k"), "batch_size": F.size("r"), "_x": each("x")}
    out |= {"transcriptions": each("t")} if text else {}
    out |= {"_c": each("c")} if codes else {}
    out |= {"ids": each("l")} if label else {}
    wide = grouped.withColumns(out).withColumn("audio_num_frames", sized(F.col("_x")))
    wide = wide.withColumn("audio", F.transform("_x", lambda a: right_pad(a, F.array_max("audio_num_frames"), F.lit(0).cast("float"))))
    if codes:
        wide = wide.withColumn("transcriptions_length", F.transform("_c", lambda a: F.size(a)))
        wide = wide.withColumn("transcriptions_idx", F.transform("_c", lambda a: right_pad(a, F.array_max("transcriptions_length"), F.lit(0))))
    return wide.drop("r", "_x", "_c")


def batch_violations(batches: DataFrame, label_values: Sequence[int] | None = None) -> DataFrame:
    """``rule, batch_id`` of batches whose parts disagree in number or width."""
    names = set(batches.columns)
    width = lambda a, n: F.exists(a, lambda v: F.size(v) != F.array_max(n))
    rules = {"audio_count": F.size("audio") != F.col("batch_size"), "key_count": F.size("keys") != F.col("batch_size"), "audio_width": width("audio", "audio_num_frames")}
    if "transcriptions_idx" in names:
        rules |= {"text_count": F.size("transcriptions_idx") != F.col("batch_size"), "text_width": width("transcriptions_idx", "transcriptions_length")}
    if "ids" in names:
        rules["id_count"] = F.size("ids") != F.col("batch_size")
        if label_values is not None:
            rules["id_values"] = F.exists("ids", lambda v: ~F.coalesce(v.isin(*label_values), F.lit(False)))
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return batches.select(F.explode(broken).alias("rule"), "batch_id")


def zip_cycle(a: DataFrame, b: DataFrame, steps: int, a_idx: str = "idx", b_idx: str = "idx") -> DataFrame:
    """``step`` with the rows of ``a`` and ``b`` (numbered from 0) that meet at it; the shorter side starts over."""
    na, nb = a.count(), b.count()
    if not na or not nb:
        raise ValueError("both sides need rows")
    at = a.sparkSession.range(steps).select(F.col("id").alias("step"), (F.col("id") % na).alias("_a"), (F.col("id") % nb).alias("_b"))
    left = a.select(F.col(a_idx).alias("_a"), F.struct(*[c for c in a.columns if c != a_idx]).alias("a"))
    right = b.select(F.col(b_idx).alias("_b"), F.struct(*[c for c in b.columns if c != b_idx]).alias("b"))
    return at.join(left, "_a").join(right, "_b").select("step", "a", "b")
