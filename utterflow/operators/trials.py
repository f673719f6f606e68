"""Verification trials: capped round-robin pair sampling without building all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import session_of, speaker_of
from ..materialize import saved
from .ordering import hash_order, prefix


def _members(df: DataFrame, group: Column, seed: int) -> DataFrame:
    """``grp, rank, key``: a seeded shuffle within each group."""
    named = df.select("key", group.alias("grp")).distinct()
    return prefix(named, hash_order(F.col("key"), seed), by=["grp"], name="rank").select("grp", "rank", "key")


def _quotas(generators: DataFrame, limit: int | None) -> DataFrame:
    """``generators`` (generator, size) with ``quota``: what each gives when all take turns, greatest names first, until ``limit``.

    The number of full rounds comes from sums of least(size, r) for many r at once; in
    the last round the generators with the greatest names still give one.
    """
    total = generators.agg(F.sum("size")).first()[0] or 0
    if limit is None or limit >= total:
        return generators.withColumn("quota", F.col("size"))
    low, high = 0, limit + 1  # full rounds: Σ least(size, low) <= limit < Σ least(size, high)
    while high - low > 1:
        step = max(1, (high - low) // 32)
        tries = list(range(low + step, high, step)) or [low + 1]
        sums = generators.agg(*[F.sum(F.least("size", F.lit(r))) for r in tries]).first()
        below = [r for r, s in zip(tries, sums) if s <= limit]
        above = [r for r, s in zip(tries, sums) if s > limit]
        low, high = max([low, *below]), min([high, *above])
    left = limit - (generators.agg(F.sum(F.least("size", F.lit(low)))).first()[0] if low else 0)
    more = prefix(generators.where(F.col("size") > low).select("generator"), [F.desc("generator")]).where(F.col("idx") < left).select("generator", F.lit(1).alias("_more"))
    out = generators.join(more, "generator", "left").withColumn("quota", F.least("size", F.lit(low)) + F.coalesce("_more", F.lit(0))).drop("_more")
    return out.where("quota > 0")


def _generators(groups: DataFrame, limit: int | None) -> DataFrame:
    """``a, b, m_b, quota`` of the pairs of groups (class, grp, m) of one class that give pairs of members.

    A pair is a generator, named ``a|b`` with a < b. Pairs are found by the groups' ranks
    within their class. With more generators than ``limit`` only the greatest-named
    ``limit`` give a pair, one each, so no others are built.
    """
    ranked = saved(prefix(groups, [F.desc("grp")], by=["class"], name="above"))
    total = ranked.agg(F.sum("above")).first()[0] or 0
    few = limit is None or total <= limit
    if few:
        taken = ranked.withColumn("take", F.col("above"))
    else:
        placed = prefix(ranked.where("above > 0"), [F.desc(F.concat("grp", F.lit("|")))], sums=["above"], name="at")
        taken = placed.withColumn("take", F.least("above", F.lit(limit) - F.col("before_above")))
    i = F.explode(F.expr("sequence(0L, take - 1)")).alias("above")
    left = taken.where("take > 0").select("class", F.col("grp").alias("a"), F.col("m").alias("m_a"), i)
    pairs = left.join(ranked.select("class", "above", F.col("grp").alias("b"), F.col("m").alias("m_b")), ["class", "above"])
    if not few:
        return pairs.select("a", "b", "m_b", F.lit(1).alias("quota"))
    sized = pairs.select("a", "b", "m_b", F.concat_ws("|", "a", "b").alias("generator"), (F.col("m_a") * F.col("m_b")).alias("size"))
    return _quotas(saved(sized), limit)


def _product_pairs(generators: DataFrame, members: DataFrame, same: bool) -> DataFrame:
    """Pairs of the first ``quota`` indices of each generator (a, b, m_b): index i is left ``i div m_b`` and right ``i mod m_b``."""
    i = F.explode(F.expr("sequence(0L, quota - 1)")).alias("i")
    index = generators.select("a", "b", "m_b", i).select("a", "b", F.expr("i div m_b").alias("ia"), F.expr("i % m_b").alias("ib"))
    left = members.select(F.col("grp").alias("a"), F.col("rank").alias("ia"), F.col("key").alias("ka"))
    right = members.select(F.col("grp").alias("b"), F.col("rank").alias("ib"), F.col("key").alias("kb"))
    return _canonical(index.join(left, ["a", "ia"]).join(right, ["b", "ib"]), same)


def _canonical(pairs: DataFrame, same: bool) -> DataFrame:
    return pairs.select(F.least("ka", "kb").alias("left"), F.greatest("ka", "kb").alias("right"), F.lit(same).alias("same_speaker"))


def positive_pairs(df: DataFrame, session_overlap: bool = False, limit: int | None = None, seed: int = 1337) -> DataFrame:
    """Same-speaker trials of ``df`` (key, ...): across sessions, or with ``session_overlap`` within a speaker."""
    if session_overlap:
        members = saved(_members(df, speaker_of(F.col("key")), seed))
        sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
        generators = sizes.select(F.col("grp").alias("generator"), "m", F.expr("m * (m - 1) div 2").alias("size")).where("size > 0")
        index = _quotas(saved(generators), limit).select(F.col("generator").alias("grp"), "m", F.explode(F.expr("sequence(0L, quota - 1)")).alias("i"))
        # combinations in order: row ra starts at ra m - ra (ra + 1) / 2
        ra = F.floor(((2 * F.col("m") - 1) - F.sqrt(((2 * F.col("m") - 1) * (2 * F.col("m") - 1) - 8 * F.col("i")).cast("double"))) / 2)
        at = lambda r: F.expr(f"{r} * m - {r} * ({r} + 1) div 2")
        index = index.withColumn("_r", ra).withColumn("_r", F.when(at("_r") > F.col("i"), F.col("_r") - 1).when(at("(_r + 1)") <= F.col("i"), F.col("_r") + 1).otherwise(F.col("_r")))
        index = index.select("grp", F.col("_r").alias("ia"), (F.col("_r") + 1 + F.col("i") - at("_r")).alias("ib"))
        left, right = (members.select("grp", F.col("rank").alias(i), F.col("key").alias(k)) for i, k in (("ia", "ka"), ("ib", "kb")))
        return _canonical(index.join(left, ["grp", "ia"]).join(right, ["grp", "ib"]), True)
    members = saved(_members(df, session_of(F.col("key")), seed))
    sessions = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).withColumn("class", speaker_of(F.col("grp")))
    return _product_pairs(_generators(sessions, limit), members, True)


def negative_pairs(df: DataFrame, same_sex: bool = True, limit: int | None = None, seed: int = 1337) -> DataFrame:
    """Different-speaker trials of ``df`` (key, gender): speakers are paired, by equal gender if ``same_sex``."""
    members = saved(_members(df, speaker_of(F.col("key")), seed))
    speakers = df.select(speaker_of(F.col("key")).alias("grp"), "gender").groupBy("grp").agg(F.min("gender").alias("gender"))
    sized = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).join(speakers, "grp").withColumn("class", F.col("gender") if same_sex else F.lit("any"))
    return _product_pairs(_generators(sized.select("class", "grp", "m"), limit), members, False)


def trial_line(trials: DataFrame) -> Column:
    return F.concat_ws(" ", "left", "right", F.col("same_speaker").cast("int").cast("string"))


def generate_trials(df: DataFrame, same_sex: bool = True, session_overlap: bool = False, limit: int | None = None, seed: int = 1337) -> DataFrame:
    """Positive, then negative trials, each capped at ``limit``."""
    return positive_pairs(df, session_overlap, limit, seed).unionByName(negative_pairs(df, same_sex, limit, seed))


def sorted_trials(trials: DataFrame) -> DataFrame:
    """Positives first, each class as text."""
    return trials.withColumn("line", trial_line(trials)).orderBy(F.desc("same_speaker"), "line")


def unordered_distinct(trials: DataFrame) -> DataFrame:
    return trials.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "same_speaker").distinct()


def convert_trials(lines: DataFrame, dataset: str) -> DataFrame:
    """Raw ``1 a.wav b.wav`` lines (column value) as trials with the dataset in front and no file ending."""
    bits = F.split(F.trim("value"), r"\s+")
    side = lambda i: F.concat(F.lit(f"{dataset}/"), F.regexp_replace(F.get(bits, i), r"\.wav$", ""))
    return lines.where(F.size(bits) == 3).select(side(1).alias("left"), side(2).alias("right"), (F.get(bits, 0) == "1").alias("same_speaker"))


def convert_plain_trials(lines: DataFrame, stem: str = "sre08/unk/unk/") -> DataFrame:
    """Raw ``a b 1`` lines as trials with a key stem in front; blank lines go."""
    bits = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(bits) == 3).select(F.concat(F.lit(stem), F.get(bits, 0)).alias("left"), F.concat(F.lit(stem), F.get(bits, 1)).alias("right"), (F.get(bits, 2) == "1").alias("same_speaker"))
