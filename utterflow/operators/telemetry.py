"""Rollups of training telemetry (run, step, metric, value) and result series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_bucket(step: Column, every: int = 100) -> Column:
    """The logging step at which a step's value is reported: the next multiple of ``every``."""
    return (F.ceil(step / every) * every).cast("bigint")


def step_means(log: DataFrame, every: int = 100, by: Sequence[str] = ("run", "metric")) -> DataFrame:
    return log.groupBy(*by, step_bucket(F.col("step"), every).alias("at_step")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def agreement(log: DataFrame, every: int = 100, by: Sequence[str] = ("run", "metric")) -> DataFrame:
    """Least, greatest and mean value and the share of positive ones per bucket; values that are no number are counted apart."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return log.groupBy(*by, step_bucket(F.col("step"), every).alias("at_step")).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.avg((v > 0).cast("double")).alias("positive_share"),
        F.count(F.when(F.isnan("value"), 1)).alias("n_nan"),
    )


def magnitude(log: DataFrame, every: int = 100, by: Sequence[str] = ("run", "metric")) -> DataFrame:
    v = F.when(~F.isnan("value"), F.col("value"))
    return log.groupBy(*by, step_bucket(F.col("step"), every).alias("at_step")).agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"))


def dynamic_weights(log: DataFrame, losses: Sequence[str], n: int = 10, temperature: float = 1.0, run: str = "run") -> DataFrame:
    """``log`` (run, step, one column per loss) with ``weight_<loss>``.

    Each loss's rate is the mean of the newer half over that of the older half of its
    last 2n values before the row; weights are the softmax of rates over temperature,
    scaled to the number of losses. Without 2n earlier rows all weights are 1.
    """
    before = Window.partitionBy(run).orderBy("step").rowsBetween(-2 * n, -1)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    out = log
    for c in losses:
        past = F.collect_list(F.col(c).cast("double")).over(before)
        out = out.withColumn(f"_p_{c}", past).withColumn(f"_e_{c}", F.exp(F.try_divide(mean(F.slice(f"_p_{c}", n + 1, n)), mean(F.slice(f"_p_{c}", 1, n))) / temperature))
    total = sum((F.col(f"_e_{c}") for c in losses[1:]), F.col(f"_e_{losses[0]}"))
    full = F.size(f"_p_{losses[0]}") == 2 * n
    weights = {f"weight_{c}": F.when(full, F.col(f"_e_{c}") / total * len(losses)).otherwise(F.lit(1.0)) for c in losses}
    return out.withColumns(weights).drop(*[f"{p}{c}" for c in losses for p in ("_p_", "_e_")])


def best_run(log: DataFrame, metric: str, run: str = "run") -> DataFrame:
    """The step of each run with the least value of a metric; ties go to the earlier step."""
    best = F.min(F.struct("value", "step"))
    return log.where(F.col("metric") == metric).groupBy(run).agg(best.alias("b")).select(run, F.col("b.step").alias("step"), F.col("b.value").alias("value"))


def best_layer(results: DataFrame) -> DataFrame:
    """The layer with the least error of each set of weights (eer, weights, layer)."""
    return results.groupBy("weights").agg(F.min(F.struct("eer", "layer")).alias("b")).select("weights", F.col("b.layer").alias("layer"), F.col("b.eer").alias("eer"))
