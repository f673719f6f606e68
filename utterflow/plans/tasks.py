"""Task pipelines: from samples to batches, as chains of operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batching
from ..operators.manifest import filter_samples
from ..operators.vocab import attach_label, encode_with


@dataclass
class BatchConfig:
    """Either a token budget or a fixed size; a fixed size needs a word on the last batch."""

    max_tokens: int | None = None
    batch_size: int | None = None
    drop_last: bool | None = None
    max_len: int | None = None
    buffer: int = 1000
    padded: bool = True
    chunk: str = "none"
    chunk_seconds: float = 2.0
    seed: int = 1337
    epoch: int = 0
    #: Buffer sizes of the shuffles of samples, before batching, and of batches; None: samples are shuffled whole, batches stay.
    shuffle_before: int | None = None
    shuffle_after: int | None = None
    filters: dict = field(default_factory=dict)

    def check(self) -> None:
        if (self.max_tokens is None) == (self.batch_size is None):
            raise ValueError("exactly one of max_tokens and batch_size is required")
        if self.batch_size is not None and self.drop_last is None:
            raise ValueError("drop_last is required with batch_size")


def assign_batches(df: DataFrame, config: BatchConfig) -> DataFrame:
    """``df`` (shard_idx, key, num_frames, ...) with ``batch_id``, in an order shuffled by seed and epoch."""
    config.check()
    if config.shuffle_before is None:
        df = df.withColumn("_order", F.md5(F.concat_ws("|", "key", F.lit(f"{config.epoch}|{config.seed}"))))
    else:
        places = batching.buffer_shuffle(df, config.shuffle_before, seed=config.seed, epoch=config.epoch)
        df = df.join(places.withColumnRenamed("place", "_order"), ["shard_idx", "key"])
    if config.batch_size is not None:
        out = batching.batch_fixed(df, config.batch_size, bool(config.drop_last), order=("_order", "key"))
    else:
        ids = batching.batch_max_tokens(df, config.max_tokens, max_len=config.max_len, buffer=config.buffer, padded=config.padded, order=("_order", "key"))
        out = df.join(ids.select("shard_idx", "key", "batch_id"), ["shard_idx", "key"])
    return out.drop("_order")


def shuffle_batches(batches: DataFrame, config: BatchConfig) -> DataFrame:
    """``batches`` with ``batch_place``, their places in their shard: by number, or shuffled through a buffer."""
    if config.shuffle_after is None:
        return batches.withColumn("batch_place", F.col("batch_id"))
    names = batches.select("shard_idx", "batch_id").withColumn("key", F.col("batch_id").cast("string"))
    places = batching.buffer_shuffle(names, config.shuffle_after, order=("batch_id",), seed=config.seed, epoch=config.epoch)
    return batches.join(places.select("shard_idx", F.col("key").cast("long").alias("batch_id"), F.col("place").alias("batch_place")), ["shard_idx", "batch_id"])


def _chunked(df: DataFrame, config: BatchConfig) -> DataFrame:
    out = batching.chunk(df, config.chunk, config.chunk_seconds, seed=config.seed, epoch=config.epoch)
    return out.withColumn("key", F.when(F.col("chunk_idx") > 0, F.concat_ws("#", "key", "chunk_idx")).otherwise(F.col("key"))).drop("chunk_idx")


def speech_batches(df: DataFrame, index: dict[str, int], config: BatchConfig) -> DataFrame:
    kept = filter_samples(df, **config.filters).withColumn("codes", encode_with(F.col("transcription"), index))
    return shuffle_batches(batching.collate(assign_batches(kept, config), text="transcription", codes="codes"), config)


def speaker_batches(df: DataFrame, speakers: DataFrame, config: BatchConfig) -> DataFrame:
    labelled, _ = attach_label(_chunked(df, config), speakers, "speaker_id")
    return shuffle_batches(batching.collate(assign_batches(labelled, config), label="label"), config)


def gender_batches(df: DataFrame, config: BatchConfig) -> DataFrame:
    """Fixed-size batches with gender 0 (m) or 1 (f); samples without one go."""
    if config.batch_size is None:
        raise ValueError("gender batches have a fixed size")
    labelled = _chunked(df, config).where(F.col("gender").isin("m", "f")).withColumn("label", (F.col("gender") == "f").cast("bigint"))
    return shuffle_batches(batching.collate(assign_batches(labelled, config), label="label"), config)


def joint_batches(df: DataFrame, index: dict[str, int], speakers: DataFrame, config: BatchConfig) -> DataFrame:
    kept, _ = attach_label(filter_samples(df, **config.filters), speakers, "speaker_id")
    kept = kept.withColumn("codes", encode_with(F.coalesce("transcription", F.lit("none")), index))
    return shuffle_batches(batching.collate(assign_batches(kept, config), text="transcription", codes="codes", label="label"), config)


def compose_sets(names: DataFrame, shards: DataFrame, trials: DataFrame) -> DataFrame:
    """``role, place, name, path, trials`` of lists (role, place, value) of names, shard folders and trial files, matched by place."""
    out = names.withColumnRenamed("value", "name")
    for more, column in ((shards, "path"), (trials, "trials")):
        out = out.join(more.withColumnRenamed("value", column), ["role", "place"], "full")
    return out


def check_sets(sets: DataFrame, trial_roles: Sequence[str] = ()) -> DataFrame:
    """``role, rule`` of set tables (role, name, path, trials) that do not fit.

    Names or paths that come twice, sets without either, lists of names, paths and, in
    ``trial_roles``, trials of different lengths, and trials in other roles.
    """
    twice = lambda c: sets.where(F.col(c).isNotNull()).groupBy("role", c).count().where("count > 1").select("role", F.lit(f"{c}_twice").alias("rule"))
    lacking = sets.where(F.col("path").isNull() | F.col("name").isNull()).select("role", F.lit("incomplete").alias("rule"))
    sizes = sets.groupBy("role").agg(*[F.count(c).alias(c) for c in ("name", "path", "trials")])
    verified = F.col("role").isin(*trial_roles) if trial_roles else F.lit(False)
    differ = lambda a, b: F.when(F.col(a) != F.col(b), F.lit(f"{a}_and_{b}_differ"))
    rules = F.array(differ("name", "path"), F.when(verified, differ("name", "trials")), F.when(~verified & (F.col("trials") > 0), F.lit("trials_not_used")))
    lengths = sizes.select("role", F.explode(F.array_compact(rules)).alias("rule"))
    return twice("name").unionByName(twice("path")).unionByName(lacking).unionByName(lengths).distinct()
