"""Speaker verification scores and error rates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import argmax, center, cosine, length_normalise, norm, to_unit_score
from ..materialize import saved
from .asr import wer
from .ordering import prefix


class Scorer(Protocol):
    """A score for pairs: ``fit`` learns from embeddings, ``score`` is a column of left and right vectors."""

    def fit(self, embeddings: DataFrame) -> "Scorer": ...

    def score(self, left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column: ...


class CosineScorer:
    def fit(self, embeddings: DataFrame) -> "CosineScorer":
        return self

    def score(self, left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
        return to_unit_score(cosine(left, right, left_norm, right_norm))


def fit_center(embeddings: DataFrame) -> DataFrame:
    """One row: per-dimension ``mean`` and unbiased ``std`` arrays."""
    flat = embeddings.select(F.posexplode("embedding").alias("d", "x"))
    stats = flat.groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_samp(F.col("x").cast("double")).alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("d", "m", "s")))  # as many entries as dimensions
    return stats.agg(rows.alias("r")).select(F.transform("r", lambda x: x["m"]).alias("mean"), F.transform("r", lambda x: x["s"]).alias("std"))


def transform_embeddings(embeddings: DataFrame, centre: bool = False, length_norm: bool = False) -> DataFrame:
    out = embeddings
    if centre:
        one = F.broadcast(fit_center(embeddings).withColumn("_one", F.lit(1)))
        out = out.withColumn("_one", F.lit(1)).join(one, "_one").withColumn("embedding", center(F.col("embedding"), F.col("mean"), F.col("std"))).drop("_one", "mean", "std")
    return out.withColumn("embedding", length_normalise(F.col("embedding"))) if length_norm else out


def missing_embeddings(trials: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``sample_id, matches`` of trial ids with no embedding, or several."""
    ids = trials.select(F.col("left").alias("sample_id")).unionByName(trials.select(F.col("right").alias("sample_id"))).distinct()
    counts = embeddings.groupBy("sample_id").agg(F.count(F.lit(1)).alias("matches"))
    return ids.join(counts, "sample_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0))).where("matches <> 1")


def score_trials(trials: DataFrame, embeddings: DataFrame, centre: bool = False, length_norm: bool = False, scorer: Scorer | None = None) -> DataFrame:
    """``left, right, y, score`` of the trials whose ids have embeddings; norms are computed once per vector."""
    scorer = (scorer or CosineScorer()).fit(embeddings)
    emb = transform_embeddings(embeddings, centre, length_norm).select("sample_id", "embedding", norm(F.col("embedding")).alias("_n"))
    left = emb.select(F.col("sample_id").alias("left"), F.col("embedding").alias("_l"), F.col("_n").alias("_ln"))
    right = emb.select(F.col("sample_id").alias("right"), F.col("embedding").alias("_r"), F.col("_n").alias("_rn"))
    score = scorer.score(F.col("_l"), F.col("_r"), F.col("_ln"), F.col("_rn"))
    return trials.join(left, "left").join(right, "right").select("left", "right", F.col("same_speaker").cast("int").alias("y"), score.alias("score"))


def check_scores(scores: DataFrame) -> DataFrame:
    """Rows whose label is not 0 or 1, or whose score is null, not a number or outside 0..1."""
    return scores.where(~F.coalesce(F.col("y").isin(0, 1) & ~F.isnan("score") & F.col("score").between(0, 1), F.lit(False)))


def _totals(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    bad = ~F.coalesce(F.col("y").isin(0, 1) & ~F.isnan("score") & F.col("score").between(0, 1), F.lit(False))
    return scores.groupBy(*by, *([] if by else [F.lit(1).alias("_g")])).agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("_q"), F.count(F.when(bad, 1)).alias("_bad")
    )


def _status() -> Column:
    return F.when(F.col("_bad") > 0, "bad_scores").when((F.col("_p") == 0) | (F.col("_q") == 0), "single_class").otherwise("ok")


def eer(scores: DataFrame, by: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """Equal error rate of (y, score), its threshold and a status, one row per group.

    Ties fold first, so the curve has one point per distinct score; running sums over
    the curve come from range totals. The rate and threshold are interpolated on the
    segment that crosses fpr + tpr = 1. Groups of one class, or with bad scores, have nulls; with
    ``compat`` 1 and 1337.
    """
    by = list(by)
    g = by or ["_g"]
    base = scores if by else scores.withColumn("_g", F.lit(1))
    points = base.groupBy(*g, "score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg"))
    curve = prefix(points, [F.desc("score")], ["pos", "neg"], by=g)
    totals = _totals(scores, by)
    curve = curve.join(totals, g).where(_status() == "ok")
    x0, y0 = F.col("before_neg") / F.col("_q"), F.col("before_pos") / F.col("_p")
    x1, y1 = (F.col("before_neg") + F.col("neg")) / F.col("_q"), (F.col("before_pos") + F.col("pos")) / F.col("_p")
    curve = curve.select(*g, "score", x0.alias("x0"), (x0 + y0).alias("s0"), x1.alias("x1"), (x1 + y1).alias("s1"))
    over = F.col("s1") >= 1
    cross = curve.groupBy(*g).agg(F.max_by(F.struct("score", "x0", "s0", "x1", "s1"), F.when(over, F.col("score"))).alias("c"), F.min(F.when(~over, F.col("score"))).alias("prev"))
    t = (1 - F.col("c.s0")) / (F.col("c.s1") - F.col("c.s0"))
    rate = F.col("c.x0") + t * (F.col("c.x1") - F.col("c.x0"))
    at = F.when(F.col("prev").isNull(), F.col("c.score")).otherwise(F.col("prev") + t * (F.col("c.score") - F.col("prev")))
    found = cross.select(*g, rate.alias("eer"), at.alias("eer_threshold"))
    out = totals.join(found, g, "left").withColumn("status", _status())
    if compat:
        out = out.withColumns({"eer": F.coalesce("eer", F.lit(1.0)), "eer_threshold": F.coalesce("eer_threshold", F.lit(1337.0))})
    return out.select(*by, "eer", "eer_threshold", "status")


def min_dcf(
    scores: DataFrame, by: Sequence[str] = (), c_miss: float = 1.0, c_fa: float = 1.0, p_target: float = 0.05, trial_no: str | None = None, compat: bool = False,
) -> DataFrame:
    """Least normalised detection cost of (y, score), its threshold and a status.

    Errors accumulate row by row in ascending (score, trial): ties do not fold. Equal
    rows need ``trial_no``, or the trial's ids, as order.
    """
    if c_miss < 1 or c_fa < 1 or not 0 <= p_target <= 1:
        raise ValueError("costs of 1 or more and a probability are required")
    by = list(by)
    g = by or ["_g"]
    base = (scores if by else scores.withColumn("_g", F.lit(1))).withColumns({"pos": F.when(F.col("y") == 1, 1).otherwise(0), "neg": F.when(F.col("y") == 0, 1).otherwise(0)})
    tie = [F.col(trial_no)] if trial_no else [F.col(c) for c in ("left", "right") if c in scores.columns]
    needed = [trial_no] if trial_no else [c for c in ("left", "right") if c in scores.columns]
    curve = prefix(base.select(*g, "score", *[c for c in needed if c not in g], "pos", "neg"), [F.col("score"), *tie], ["pos", "neg"], by=g)
    totals = _totals(scores, by)
    curve = curve.join(totals, g).where(_status() == "ok")
    fnr = (F.col("before_pos") + F.col("pos")) / F.col("_p")
    fpr = 1 - (F.col("before_neg") + F.col("neg")) / F.col("_q")
    cost = c_miss * fnr * p_target + c_fa * fpr * (1 - p_target)
    best = curve.select(*g, "score", "idx", cost.alias("cost")).groupBy(*g).agg(F.min(F.struct("cost", "idx", "score")).alias("b"))
    floor = min(c_miss * p_target, c_fa * (1 - p_target))
    found = best.select(*g, (F.col("b.cost") / F.lit(floor)).alias("mdc"), F.col("b.score").alias("mdc_threshold"))
    out = totals.join(found, g, "left").withColumn("status", _status())
    if compat:
        out = out.withColumns({"mdc": F.coalesce("mdc", F.lit(1.0)), "mdc_threshold": F.coalesce("mdc_threshold", F.lit(1337.0))})
    return out.select(*by, "mdc", "mdc_threshold", "status")


def evaluate(trials: DataFrame, embeddings: DataFrame, compat: bool = False, **options) -> DataFrame:
    """One row: eer, mdc, thresholds, counts and status; a missing or repeated embedding leaves no figures (``compat``: -1)."""
    scores = saved(score_trials(trials, embeddings, **options))  # two curves are drawn from them
    bad = missing_embeddings(trials, embeddings).agg(F.count(F.lit(1)).alias("n_missing"), F.lit(1).alias("_one"))
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  # frames of one row each
    e, m = eer(scores), min_dcf(scores).drop("status")
    out = one(e).join(F.broadcast(one(m)), "_one").join(F.broadcast(bad), "_one").drop("_one")
    whole = F.col("n_missing") == 0
    none = F.lit(-1.0) if compat else F.lit(None).cast("double")
    values = {c: F.when(whole, F.col(c)).otherwise(none) for c in ("eer", "eer_threshold", "mdc", "mdc_threshold")}
    return out.withColumns(values | {"status": F.when(whole, F.col("status")).otherwise("missing_embeddings")})


def evaluate_sets(sets: DataFrame, trials: DataFrame, embeddings: DataFrame, predictions: DataFrame, compat: bool = False, **options) -> DataFrame:
    """``key, value, status``: the figures of all test sets (name, mode), named as in ``test_eer_<name>``.

    Mode speaker gives eer, eer_threshold, mdc and mdc_threshold of trials (set, left, right,
    same_speaker) and embeddings (set, sample_id, embedding), speech gives wer of predictions
    (set, ref, hyp), and joint gives both. All sets are scored together and figures are
    grouped by set. A set without its data, or with missing embeddings, has null figures (``compat``: -1).
    """
    known = F.col("mode").isin("speaker", "speech", "joint")
    if not (unknown := sets.where(~F.coalesce(known, F.lit(False)))).isEmpty():
        raise ValueError(f"unknown mode {unknown.first()['mode']}")
    named = lambda c: F.concat_ws("\x1f", "set", c)  # noqa: E731  # ids are those of a set
    speaker = sets.where(F.col("mode") != "speech").select(F.col("name").alias("set"))
    asked = trials.join(F.broadcast(speaker), "set", "left_semi").select(named("left").alias("left"), named("right").alias("right"), "same_speaker")
    vectors = embeddings.join(F.broadcast(speaker), "set", "left_semi").select(named("sample_id").alias("sample_id"), "embedding")
    set_of = lambda c: F.substring_index(c, "\x1f", 1)
    scores = saved(score_trials(asked, vectors, **options).withColumn("set", set_of("left")))
    missing = missing_embeddings(asked, vectors).groupBy(set_of("sample_id").alias("set")).agg(F.count(F.lit(1)).alias("_missing"))
    rates = eer(scores, ["set"], compat).join(min_dcf(scores, ["set"], compat=compat).drop("status"), "set", "full")
    rates = speaker.join(rates, "set", "left").join(missing, "set", "left")
    none = F.lit(-1.0) if compat else F.lit(None).cast("double")
    status = F.when(F.col("_missing") > 0, "missing_embeddings").otherwise(F.coalesce("status", F.lit("no_trials")))
    figures = lambda df, names, status: df.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"test_{n}_"), "set").alias("key"), F.col(n).alias("value"), status.alias("status")) for n in names])).alias("f")).select("f.*")
    rates = rates.withColumns({c: F.when(F.col("_missing").isNull(), F.col(c)).otherwise(none) for c in ("eer", "eer_threshold", "mdc", "mdc_threshold")})
    words = sets.where(F.col("mode") != "speaker").select(F.col("name").alias("set")).join(wer(predictions, ["set"]), "set", "left")
    return figures(rates, ("eer", "eer_threshold", "mdc", "mdc_threshold"), status).unionByName(
        figures(words, ("wer",), F.when(F.col("wer").isNull(), F.lit("no_words")).otherwise(F.lit("ok")))
    )


def top1_accuracy(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", label: str = "label") -> DataFrame:
    hit = (argmax(F.col(prediction)) == F.col(label)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def pool_frames(frames: DataFrame, how: str = "mean") -> DataFrame:
    """``key, embedding`` of frames (key, idx, frame): their mean, or the first one."""
    if how == "first":
        return frames.groupBy("key").agg(F.min_by("frame", "idx").alias("embedding"))
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    flat = frames.select("key", F.posexplode("frame").alias("d", "x")).groupBy("key", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "m")))
    return flat.groupBy("key").agg(F.transform(ordered, lambda s: s["m"]).alias("embedding"))
