"""Shard plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import saved
from .ordering import hash_order, parts, prefix

STRATEGIES = ("random", "length_sorted", "single_shard")


def plan_shards(df: DataFrame, strategy: str, samples_per_shard: int = 5000, seed: int = 1337, key: str = "key", length: str = "num_frames") -> DataFrame:
    """``key, shard_idx, partial_shard``: a shard is partial if it holds fewer samples than the fullest, as only the last can."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "single_shard":
        return df.select(F.col(key).alias("key"), F.lit(0).cast("bigint").alias("shard_idx"), F.lit(False).alias("partial_shard"))
    rows = saved(df.select(key, length))  # counted, sampled for ranges and dealt to them
    total = rows.count()
    order = hash_order(F.col(key), seed) if strategy == "random" else [F.col(length), F.col(key)]
    placed = prefix(rows, order, ranges=parts(total)).select(F.col(key).alias("key"), F.floor(F.col("idx") / samples_per_shard).cast("bigint").alias("shard_idx"))
    partial = F.lit(False)
    if total > samples_per_shard and total % samples_per_shard:
        partial = F.col("shard_idx") == total // samples_per_shard
    return placed.withColumn("partial_shard", partial)


def equal_shards_per_worker(shards: DataFrame, workers: int, order: str = "path") -> DataFrame:
    """``shards`` with ``worker``, so that all workers get as many; what is left over is dropped."""
    total = shards.count()
    n = total // workers * workers
    numbered = prefix(shards, [F.col(order)], ranges=parts(total))
    return numbered.where(F.col("idx") < n).withColumn("worker", (F.col("idx") % workers).cast("int")).drop("idx")
