"""Connected components, and the groups that exact Jaccard links among sets that share a band."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..materialize import discard, release
from .frames import saved

#: Levels of hubs that one round takes.
LEVELS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node of ``edges`` (a, b); the component is its least id.

    Alternating large-star and small-star steps: each links nodes to smaller ones of
    their neighbourhood, so a component becomes a star around its least node in a
    number of rounds logarithmic in its size. Least neighbours come from partial
    aggregation, and a node with very many neighbours is a skewed join that Spark can
    split. Rounds are written tables; they end when the edges are stars.
    """
    up = lambda df, a, b: df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = saved(up(edges.where(F.col("a") != F.col("b")), F.col("a"), F.col("b")).distinct())
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, now = now, saved(small.distinct())
        discard(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, or only edges from greater ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def buckets_with_company(band_rows: DataFrame) -> DataFrame:
    """``band, id, center`` for the rows of (band, id) whose band has two ids or more; center is its least id."""
    shared = band_rows.groupBy("band").agg(F.min("id").alias("center"), F.max("id").alias("_last"))
    # written first, so that Spark can split a hot band's rows in the join
    return band_rows.join(saved(shared.where(F.col("center") != F.col("_last")).drop("_last")), "band")


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows of ``pairs`` (a, b, ...) whose sets (id, n, set) have an exact Jaccard of ``percent`` / 100 or more."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("set").alias("_sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("set").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    alike = 100 * both >= percent * (F.col("_na") + F.col("_nb") - both)
    close = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
    return pairs.join(left, "a").join(right, "b").where(close).where(alike).select(*pairs.columns).distinct()


def prefix_keys(sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """``key, id, n, rest``, and the tables that it is made from: the elements of each set's prefix that a set of another component has too.

    Elements are ordered from those of one component, then from rare to common among ``sets``
    (row, id, component, n, set). Two sets of Jaccard t share one of the n - ceil(t n) + 1
    first elements of each, so pairs of two components without such an element need no
    comparison. ``rest`` counts the elements from the key on that another component has: two
    sets whose first common element is the key share no more than the lesser ``rest``.
    """
    flat = saved(sets.select("row", "id", "component", "n", F.explode("set").alias("key")))
    often = flat.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    often = saved(often.where("lo <> hi").select("key", "df"))
    shared = flat.join(often, "key").groupBy("row", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared"))
    length = F.size("shared") - F.ceil(F.col("n") * percent / 100) + 1
    first = F.slice("shared", 1, F.greatest(length, F.lit(0)).cast("int"))
    placed = shared.select("id", "n", F.size("shared").alias("m"), F.posexplode(first).alias("at", "e"))
    return placed.select(F.col("e.key").alias("key"), "id", "n", (F.col("m") - F.col("at")).alias("rest")).distinct(), [flat, often]


def linked_components(company: DataFrame, fetch_sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``id, component`` of the ids that exact links of Jaccard ``percent`` / 100 or more join, among ids that share a band.

    ``company`` comes from ``buckets_with_company`` and ``fetch_sets`` turns a table of
    distinct ids into ``id, n, set``. No group is expanded into its pairs. First, every id
    is compared with one hub, the least centre of its bands. Bands that then hold several
    components are live; their ids meet again under the rare elements that a link requires
    (``prefix_keys``). Under each such key, members become hubs from the highest to the
    lowest level, a level being half as likely as the one below it: a round compares the
    hubs of LEVELS levels with the members of other components, joins what is linked, and
    retires the hubs. Pairs with too few elements left from the key on are passed over; their
    first common element decides. So a group of near copies costs a few comparisons for each member,
    and members that no hub has reached are compared with each other in the last rounds.
    Every pair that shares a band is linked, or compared, or can't be similar. The result is a
    saved table; the others that it took are deleted.
    """
    sets = saved(fetch_sets(company.select("id").distinct()).withColumn("row", F.monotonically_increasing_id()))
    out = _linked(company, sets, percent)
    discard(sets)
    release(sets.sparkSession)
    return out


def _linked(company: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    hub = company.groupBy("id").agg(F.min("center").alias("b")).where(F.col("id") != F.col("b"))
    found = saved(similar_pairs(hub.select(F.col("id").alias("a"), "b"), sets, percent))
    now = saved(connected_components(found))
    live = company.select("band", "id").join(now, "id", "left").select("band", "id", _own().alias("component"))
    live = live.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    ids = saved(company.join(saved(live.select("band")), "band", "left_semi").select("id").distinct())
    if ids.isEmpty():
        return now
    level = F.floor(-F.log2((F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) + 1) / float(1 << 40))).cast("int")
    known = ids.join(now, "id", "left").select("id", _own().alias("component"))
    keys, used = prefix_keys(sets.join(known, "id"), percent)
    rows = held = saved(keys.withColumn("level", level))
    for table in used:
        discard(table)
    while True:
        rows = rows.join(now, "id", "left").select("key", "id", "n", "rest", "level", _own().alias("component"))
        keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("level").alias("top")).where("lo <> hi")
        keys = saved(keys.select("key", "top"))
        rows = saved(rows.join(keys, "key"))
        discard(held)
        discard(keys)
        held = rows
        if rows.isEmpty():
            return now
        hub = F.col("level") > F.col("top") - LEVELS
        hubs = rows.where(hub).select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rest_b"), F.col("level").alias("level_b"), F.col("component").alias("cb"))
        near = 100 * F.least("rest", "rest_b") >= percent * (F.col("n") + F.col("nb") - F.least("rest", "rest_b"))
        new = (F.col("component") != F.col("cb")) & ((F.col("level") < F.col("level_b")) | ((F.col("level") == F.col("level_b")) & (F.col("id") < F.col("b"))))
        pairs = rows.join(hubs, "key").where(near & new).select(F.col("id").alias("a"), "b", F.col("component").alias("ca"), "cb").distinct()
        merged = similar_pairs(pairs, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = saved(connected_components(merged).select(F.col("id").alias("component"), F.col("component").alias("_to")))
        if not merged.isEmpty():
            moved = now.join(merged, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
            fresh = merged.join(now, merged["component"] == now["id"], "left_anti").select(F.col("component").alias("id"), F.col("_to").alias("component"))
            before, now = now, saved(moved.unionByName(fresh))
            discard(before)
        discard(merged)
        rows = rows.where(~hub).select("key", "id", "n", "rest", "level")


def _own() -> Column:
    return F.coalesce("component", "id")


def batches_of(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: (fn(b) for b in batches)
