"""Mix sources to target weights, to the word.

Every row gets a key from a hash of its id. Within a source, keys are cut into even
ranges; sums of each range give every range its start, and a running sum within the
range gives every row its place. A row is taken once for every whole epoch of its
source's target, and once more, in part for the row at the cut, while the place is
below what is left of the target.

Cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its
own, last in order; rows with one id tie and are ordered by size, equal rows are
interchangeable; a source without words has target 0; an empty table gives an empty
result. Columns besides id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import saved, words


#: Rows that one folded row becomes at once.
COPIES = 10_000


def water_fill(sources: DataFrame, source_col: str, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``sources`` (one row each, with ``source_size``) with ``weight`` and ``target``.

    Targets share the sum of all sizes by weight, none above ``max_epochs`` times its
    source; the excess goes to the others by weight until none is above. All sums over
    sources are distributed; the driver holds one number per round, and each round
    fixes the sources above their share for good, so rounds end when no more do.
    """
    ranked = sources.repartitionByRange(F.col(source_col).asc_nulls_last()).sortWithinPartitions(F.col(source_col).asc_nulls_last())
    ranked = saved(ranked.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_order")))
    parts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_order")) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    sized = ranked.withColumn("_rank", rank).join(parts, "_part").withColumn(
        "weight", F.get(choice, ((F.col("_rank") + F.col("_before")) % len(weights)).cast("int"))
    )
    sized = saved(sized.select(source_col, "source_size", "weight", (F.col("source_size") * max_epochs).cast("double").alias("_most")))
    total = sized.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("_most") <= F.col("weight") * F.lit(level)
        n, fixed, open_weight = sized.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("_most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - fixed) / open_weight
    return sized.select(source_col, "source_size", "weight", F.least("_most", F.col("weight") * F.lit(level)).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, rows_per_range: int = 1_000,
) -> DataFrame:
    """Id, size, source_size, target and taken of every row.

    One scan of the texts; then only (id, source, size, key) moves. ``rows_per_range``
    sets how finely keys are cut: a source with a third of all rows spreads over as
    many ranges as its rows need. Rows of one id, source and size, such as those of a null
    id, fold into one row with their number before anything is ordered, and unfold at the
    end. Sums of ranges meet in two steps, ranges of a coarse range and coarse ranges of a
    source, so neither step sees more than the square root of the ranges.
    """
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))))
    sized = saved(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.size(words(F.col(text_col))).cast("long").alias("size"), key.alias("_key")))
    by_source = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    targets = saved(water_fill(by_source, "_source", weights, max_epochs))
    rows = sized.count()
    digits = 2
    while 16**digits * rows_per_range < rows and digits < 10:
        digits += 2
    folded = sized.groupBy("_source", "_key", "_id", "size").agg(F.count(F.lit(1)).alias("_n"))
    folded = saved(folded.withColumns({"_range": F.substring("_key", 1, digits), "_words": F.col("size") * F.col("_n")}))
    earlier = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = folded.groupBy("_source", "_range").agg(F.sum("_words").alias("_sum")).withColumn("_coarse", F.substring("_range", 1, digits // 2))
    coarse = fine.groupBy("_source", "_coarse").agg(F.sum("_sum").alias("_sum"))
    coarse = coarse.select(F.col("_source").alias("_s"), F.col("_coarse").alias("_c"), earlier("_sum", ["_source"], "_coarse").alias("_before"))
    fine = fine.withColumn("_within", earlier("_sum", ["_source", "_coarse"], "_range"))
    sums = fine.join(coarse, fine["_source"].eqNullSafe(coarse["_s"]) & (fine["_coarse"] == coarse["_c"])).select("_source", "_range", (F.col("_before") + F.col("_within")).alias("_start"))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("_inside", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    # the target goes to the ranges first, so that rows join by source and range, never by a hot source alone
    t = targets.withColumnsRenamed({"_source": "_t"})
    sums = sums.join(t, sums["_source"].eqNullSafe(t["_t"])).drop("_t").withColumnsRenamed({"_source": "_s", "_range": "_g"})
    placed = placed.join(sums, placed["_source"].eqNullSafe(sums["_s"]) & (placed["_range"] == sums["_g"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor("target") - epochs * F.col("source_size") - F.col("_start") - F.col("_inside") - F.col("_copy") * F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    # copies unfold in blocks, so that no row becomes more than COPIES at once and blocks spread over tasks
    few = placed.where(F.col("_n") <= COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES)))
    many = saved(placed.where(F.col("_n") > COPIES).withColumn("_block", block))
    if not many.isEmpty():
        last = F.least(F.col("_n"), (F.col("_block") + 1) * COPIES) - 1
        few = few.unionByName(many.repartition("_id", "_block").withColumn("_copy", F.explode(F.sequence(F.col("_block") * COPIES, last))).drop("_block"))
    return few.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))
