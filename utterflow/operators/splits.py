"""Splits that never divide a group, and routing to splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import GENDERS
from .ordering import hash_order, prefix


def split_by_group(df: DataFrame, group: str, ratio: float, seed: int = 1337) -> DataFrame:
    """``df`` with ``is_split``: groups in seeded order move to the split until it holds ``ratio`` of the rows.

    Only group counts are ordered; the flags come back by a join on the group.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    ordered = prefix(counts, hash_order(F.col(group), seed), ["n"])
    chosen = ordered.select(F.col(group).alias("_g"), (F.col("before_n") < F.lit(ratio * total)).alias("is_split"))
    return df.join(chosen, df[group].eqNullSafe(chosen["_g"])).drop("_g")


def split_balanced(df: DataFrame, group: str, balance: str, ratio: float, seed: int = 1337, classes: tuple[str, str] = GENDERS) -> DataFrame:
    """As ``split_by_group``, one group of each class at a step; groups without a partner or class stay out."""
    counts = df.groupBy(group, balance).agg(F.count(F.lit(1)).alias("n")).where(F.col(balance).isin(*classes))
    total = df.count()
    ranked = prefix(counts, hash_order(F.col(group), seed), by=[balance], name="step")
    steps = ranked.groupBy("step").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == len(classes))
    moved = prefix(steps, [F.col("step")], ["n"]).where(F.col("before_n") < F.lit(ratio * total)).select("step")
    chosen = ranked.join(moved, "step", "left_semi").select(F.col(group).alias("_g"), F.lit(True).alias("_in")).distinct()
    return df.join(chosen, df[group].eqNullSafe(chosen["_g"]), "left").withColumn("is_split", F.coalesce("_in", F.lit(False))).drop("_g", "_in")


def route(df: DataFrame, split_map: DataFrame, on: str = "speaker_id") -> DataFrame:
    """``df`` with ``split_idx`` of its id; of several the last wins, without any it is null."""
    last = split_map.groupBy(on).agg(F.max("split_idx").alias("split_idx"))
    return df.join(last, on, "left")


def complement(df: DataFrame, split: DataFrame, on: str = "key") -> DataFrame:
    return df.join(split.select(on), on, "left_anti")
