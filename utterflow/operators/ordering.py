"""Global row numbers and running sums without an unpartitioned window.

Rows are dealt to ranges of the order, ranges get totals, and only the totals, one row
per range and group, are summed across ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import saved


#: Narrow rows of a part, which one task sorts or folds: as few as keep the number of parts within
#: ``UNSORTED``, where shuffles are written as they come (``spark.shuffle.sort.bypassMergeThreshold``),
#: and never more than the second figure.
PART_ROWS = (1 << 17, 1 << 21)
UNSORTED = 200


def parts(rows: int) -> int:
    """Into how many parts to deal so many narrow rows."""
    most, least = (-(-rows // n) for n in PART_ROWS)
    return max(1, least, min(most, UNSORTED))


def prefix(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), by: Sequence[str] = (), name: str = "idx", ranges: int | None = None) -> DataFrame:
    """``df`` with a dense 0-based ``idx`` in the order, and ``before_<c>``, the exclusive sum, for each of ``sums``.

    ``by`` restarts both per group; a large group still spreads over many ranges. The
    order should be total: rows that tie in it share a range and get numbers in any
    order. Null groups are groups.

    Rows are saved in order, so a row's place in its range is its number there: no range is
    dealt out or sorted again. Only ``sums`` need a window, to which each range is a part.
    Without ``ranges``, Spark sizes them by their bytes.
    """
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = saved(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_pid", F.shiftright("_at", 33).cast("int"))
    totals = ranged.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(
        F.col("_pid").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in by],
        (zero(F.sum("_n").over(across)) - F.col("_first")).alias("_shift"), *[zero(F.sum(f"_s_{c}").over(across)).alias(f"_s_{c}") for c in sums],
    )
    totals = saved(totals) if by else F.broadcast(totals)  # a row per range; with groups, Spark goes by the size of the file
    local = ranged
    if sums:
        inside = Window.partitionBy("_pid", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        n = (ranged.agg(F.max("_pid")).first()[0] or 0) + 1
        local = ranged.repartitionById(n, "_pid").withColumns({f"before_{c}": zero(F.sum(c).over(inside)) for c in sums})
    match = local["_pid"] == totals["_p"]
    for c in by:
        match = match & local[c].eqNullSafe(totals[f"_k_{c}"])
    joined = local.join(totals, match)
    joined = joined.withColumns({name: F.col("_at") + F.col("_shift")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"_s_{c}") for c in sums})
    return joined.drop("_at", "_pid", "_p", "_shift", *[f"_k_{c}" for c in by], *[f"_s_{c}" for c in sums])


def hash_order(col: Column, seed: int | str, *more: Column) -> list[Column]:
    """A seeded shuffle as an order: by the md5 of ``col|seed``, then the column itself."""
    return [F.md5(F.concat_ws("|", col.cast("string"), F.lit(str(seed)))), col, *more]
