"""Hard negatives by a multiway tree of split points with distance ranges (GNAT) and exact leaves.

A bounded sample gives a tree: each node has up to FAN split points, far from each other,
and a vector goes to the child of its nearest split point. All rows are dealt to the
leaves, and every pair (split point i, sibling subtree j) gets the least and the greatest
distance from i to the rows of j, from one aggregation over all rows. A query wants rows
whose score lies in a window; with the norms of a subtree this is an annulus of distances
around the anchor, and a sibling goes where the annulus, seen from any split point of the
node, misses its range. The leaves that are left are scored exactly, in blocks.

Positives come first: the anchor's own leaf gives a lower bound of its k-th best score, and
then all leaves that can hold a better row. Each positive's score then gives a window for
its negatives, whose lower end is raised in the same way. Equal vectors of one label fold
into one class with its least ids, as many as can be returned, so a vector that very
many rows share costs one row and one query.

Scores are integers: components become floor(``scale`` * x), and sums of products are exact
as long as they fit 63 bits; larger ones raise an error.

Cases: rows with a null label, id or vector, or with a component that is null, NaN or
infinite take no part; of shorter vectors the missing components count as 0; rows that
repeat id, label and vector count once, and rows of one id that differ in these are rows
of their own, but no positives of their own id; equal scores go by the least id; an
anchor without positives, or a positive without negatives, gives no row; an empty table
gives an empty result. Columns besides id, vector and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import hash_sample, saved

#: Split points of a node; classes of the sample; wanted classes of a leaf; most levels.
FAN, SAMPLE, LEAF_ROWS, LEVELS = 8, 16_384, 1_024, 4
#: Classes scored together, and queries at a time.
BLOCK_ROWS, QUERY_ROWS = 8_192, 256
#: Allowance for rounding where distances are compared.
SLACK = 1e-6
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows (a x b)."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 1 << 62:
        raise ValueError("inner products do not fit 63 bits; use a smaller scale")
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows (a x b)."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * products(a, b)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``dim`` columns; missing ends are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


@dataclass
class Node:
    """Split points, the child below each (a node, or a leaf's number), and, per split point and child, the range of distances."""

    points: np.ndarray
    children: list[Node | int]
    low: np.ndarray = field(default_factory=lambda: np.empty(0))
    high: np.ndarray = field(default_factory=lambda: np.empty(0))
    norms: np.ndarray = field(default_factory=lambda: np.empty(0))


def grow(sample: np.ndarray, leaves: int) -> tuple[Node, int]:
    """A tree of about ``leaves`` leaves over the sample, and how many it has."""
    count = 0

    def split(rows: np.ndarray, wanted: float, level: int) -> Node | int:
        nonlocal count
        fan = int(min(FAN, np.ceil(wanted), len(rows)))
        points = _far_points(rows, fan) if fan > 1 and level < LEVELS else rows[:0]
        if len(points) < 2:
            count += 1
            return count - 1
        own = squares(rows, points).argmin(1)
        return Node(points, [split(rows[own == k], wanted * (own == k).mean(), level + 1) for k in range(len(points))])

    root = split(sample, leaves, 0)
    return (root if isinstance(root, Node) else Node(np.zeros((1, sample.shape[1]), np.int64), [0])), count


def _far_points(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows, each the farthest from those before it."""
    chosen = [0]
    near = squares(rows, rows[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(rows, rows[chosen[-1] :][:1])[:, 0])
    return rows[chosen]


def leaf_paths(root: Node) -> list[list[tuple[Node, int]]]:
    """Nodes and children from the root to each leaf."""
    out: dict[int, list] = {}

    def walk(node: Node, path: list) -> None:
        for k, child in enumerate(node.children):
            here = [*path, (node, k)]
            if isinstance(child, Node):
                walk(child, here)
            else:
                out[child] = here

    walk(root, [])
    return [out[k] for k in range(len(out))]


def dealt(root: Node, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of every row, and its distances to the split points of the nodes that it passes (levels x FAN; -1 where there is none)."""
    leaf = np.zeros(len(rows), np.int64)
    seen = np.full((len(rows), LEVELS * FAN), -1.0)

    def walk(node: Node, at: np.ndarray, level: int) -> None:
        far = np.sqrt(squares(rows[at], node.points))
        seen[at, level * FAN : level * FAN + len(node.points)] = far
        own = far.argmin(1)
        for k, child in enumerate(node.children):
            below = at[own == k]
            if isinstance(child, Node):
                walk(child, below, level + 1)
            else:
                leaf[below] = child

    walk(root, np.arange(len(rows)), 0)
    return leaf, seen


def set_ranges(root: Node, low: np.ndarray, high: np.ndarray, norms: np.ndarray) -> None:
    """Ranges of all nodes from those of the leaves: (leaves x levels x FAN) distances, (leaves x 2) squared norms; leaves without rows have low > high."""

    def walk(node: Node, level: int) -> list[int]:
        below = [walk(c, level + 1) if isinstance(c, Node) else [c] for c in node.children]
        n = len(node.points)
        node.low = np.stack([low[b, level, :n].min(0) for b in below], axis=1)
        node.high = np.stack([high[b, level, :n].max(0) for b in below], axis=1)
        node.norms = np.stack([[norms[b, 0].min(), norms[b, 1].max()] for b in below])
        return [x for b in below for x in b]

    walk(root, 0)


def reached(root: Node, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf): the leaves that can hold a row whose score with the query's anchor lies from low to high."""
    own = (anchors * anchors).sum(1).astype(np.float64)
    queries, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def walk(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        far = np.sqrt(squares(anchors[at], node.points))
        for k, child in enumerate(node.children):
            # |v - a|^2 = |a|^2 + |v|^2 - 2 score, with |v|^2 in the child's range
            if node.norms[k, 0] > node.norms[k, 1]:
                continue
            most = own[at] + node.norms[k, 1] - 2.0 * low[at]
            outer = np.sqrt(np.maximum(most, 0)) + SLACK * (1 + np.sqrt(own[at]))
            inner = np.sqrt(np.maximum(own[at] + node.norms[k, 0] - 2.0 * high[at], 0)) * (1 - SLACK) - SLACK
            slack = SLACK * (1 + far)
            meets = (node.low[:, k] <= far + outer[:, None] + slack) & (node.high[:, k] >= np.maximum(far - outer[:, None], inner[:, None] - far) - slack)
            ok = at[(most >= -SLACK * (1 + own[at])) & meets.all(1)]
            if isinstance(child, Node):
                walk(child, ok)
            else:
                queries.append(ok)
                leaves.append(np.full(len(ok), child))

    walk(root, np.arange(len(anchors)))
    return np.concatenate(queries), np.concatenate(leaves)


@dataclass
class Index:
    """All classes dealt to leaves and blocks: rows (leaf, block, cid, label, vector, ids), the tree and the blocks of each leaf."""

    rows: DataFrame
    root: Node
    blocks: np.ndarray
    dim: int


def build_index(classes: DataFrame, leaves: int | None = None) -> Index:
    """The tree from a sample of at most SAMPLE classes, and ranges and blocks from all of them.

    What the driver gets is the sample and a row per leaf, at most FAN ** LEVELS.
    """
    n = classes.count()
    dim = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = hash_sample(classes.select("cid", "vector"), "cid", SAMPLE, 7).select("vector").toArrow().column(0)
    root, count = grow(matrix(sample, dim), leaves or max(1, min(FAN**LEVELS, n // LEAF_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vector"), dim)
            leaf, seen = dealt(root, rows)
            bounds = np.arange(len(rows) + 1) * seen.shape[1]
            more = [pa.array(leaf.astype(np.int32)), pa.array((rows * rows).sum(1)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(seen.reshape(-1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "leaf", "norm", "seen"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    placed = saved(classes.mapInArrow(run, f"{columns}, leaf int, norm long, seen array<double>"))
    ends = [f(F.element_at("seen", k + 1)).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in range(LEVELS * FAN)]
    found = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("norm_0"), F.max("norm").alias("norm_1"), *ends).toPandas()
    low, high = np.full((count, LEVELS * FAN), np.inf), np.full((count, LEVELS * FAN), -np.inf)
    norms, blocks = np.tile([np.inf, -np.inf], (count, 1)), np.zeros(count, np.int64)
    at = found["leaf"].to_numpy(np.int64)
    low[at], high[at] = found[[f"min_{k}" for k in range(LEVELS * FAN)]].to_numpy(float), found[[f"max_{k}" for k in range(LEVELS * FAN)]].to_numpy(float)
    norms[at], blocks[at] = found[["norm_0", "norm_1"]].to_numpy(float), -(-found["n"].to_numpy(np.int64) // BLOCK_ROWS)
    set_ranges(root, low.reshape(count, LEVELS, FAN), high.reshape(count, LEVELS, FAN), norms)
    spark = classes.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(k, int(b)) for k, b in enumerate(blocks)], "leaf int, blocks long"))  # a row per leaf
    rows = placed.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"), "cid", "label", "vector", "ids")
    return Index(rows, root, blocks, dim)


def best_in_windows(index: Index, queries: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
    """``cid, hi, score, id``: up to ``k`` best rows of each query (cid, label, vector, lo, hi), least ids first where scores tie.

    Rows have the query's label or, unless ``same``, another, and a score from lo to hi. With
    ``home``, only the leaf of the query's own vector is searched. Queries stream past one
    block of rows at a time, so a task holds a block and a slice of queries.
    """
    root, blocks, dim = index.root, index.blocks, index.dim

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vector"), dim)
            if home:
                query, leaf = np.arange(len(rows)), dealt(root, rows)[0]
            else:
                query, leaf = reached(root, rows, *(batch.column(c).to_numpy().astype(np.float64) for c in ("lo", "hi")))
            each = blocks[leaf]
            query, leaf = np.repeat(query, each), np.repeat(leaf, each)
            block = np.arange(len(leaf)) - np.repeat(np.cumsum(each) - each, each)
            for a in range(0, len(leaf), 4096):
                part = batch.take(pa.array(query[a : a + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[a : a + 4096].astype(np.int32)), pa.array(block[a : a + 4096].astype(np.int32)), *part.columns], ["leaf", "block", *part.schema.names])

    queries = queries.select("cid", "label", "vector", "lo", "hi")
    label = queries.schema["label"].dataType.simpleString()
    visiting = queries.mapInArrow(visits, f"leaf int, block int, cid long, label {label}, vector array<long>, lo long, hi long")
    none = F.lit(None).cast("long")
    both = index.rows.select("leaf", "block", F.lit(0).alias("side"), "cid", "label", "vector", none.alias("lo"), none.alias("hi"), "ids").unionByName(
        visiting.select("leaf", "block", F.lit(1).alias("side"), "cid", "label", "vector", "lo", "hi", F.lit(None).cast("array<long>").alias("ids"))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("leaf", "block", "side")])
            cuts = np.flatnonzero(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(0), [True])))
            for a, b in zip(cuts[:-1], cuts[1:]):
                leaf, number, side = place[:, a].tolist()
                if (leaf, number) != key:
                    key, block = (leaf, number), []
                part = batch.slice(a, b - a)
                if side == 0:
                    block.append(part.select(["label", "vector", "ids"]))
                    continue
                if block and not isinstance(block, Block):
                    block = Block(block, dim)
                if block:
                    for c in range(0, b - a, QUERY_ROWS):
                        yield block.best(part.slice(c, QUERY_ROWS), same, k)

    dealt_ = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "side")
    found = dealt_.mapInArrow(score, "cid long, hi long, score long, ids array<long>")
    flat = found.select("cid", "hi", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("cid", "hi").orderBy(F.desc("score"), "id")
    return flat.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")


class Block:
    """The classes of one block, ready to be scored."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.ids = rows.column("ids").combine_chunks()
        self.label = rows.column("label").to_numpy()
        self.vectors = matrix(rows.column("vector"), dim)
        offsets = self.ids.offsets.to_numpy()
        self.first = self.ids.flatten().to_numpy()[offsets[:-1] - offsets[0]]
        self.dim = dim

    def best(self, queries: pa.RecordBatch, same: bool, k: int) -> pa.RecordBatch:
        scores = products(matrix(queries.column("vector"), self.dim), self.vectors)
        label, low, high = (queries.column(c).to_numpy() for c in ("label", "lo", "hi"))
        inside = ((self.label == label[:, None]) == same) & (scores >= low[:, None]) & (scores <= high[:, None])
        rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q in np.flatnonzero(inside.any(1)):
            at = np.flatnonzero(inside[q])
            if len(at) > k:
                at = at[scores[q, at] >= np.partition(scores[q, at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((self.first[at], -scores[q, at]))][:k]
            rows.append(np.full(len(at), q))
            places.append(at)
        row, at = np.concatenate(rows), np.concatenate(places)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([queries.column("cid").take(take), queries.column("hi").take(take), pa.array(scores[row, at]), self.ids.take(pa.array(at))], ["cid", "hi", "score", "ids"])


def raised(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``queries`` with lo raised to the k-th best score that ``found`` (cid, hi, score) has for them."""
    kth = saved(found.groupBy("cid", "hi").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth")).where(F.col("_n") >= k))
    joined = queries.join(kth.drop("_n"), ["cid", "hi"], "left")
    return joined.withColumn("lo", F.greatest("lo", F.coalesce("_kth", "lo"))).drop("_kth")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, percent: int = 80, leaves: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, a row per mined negative.

    An anchor is a row for which ``is_anchor`` holds. Its positives are its best rows of the same
    label; each positive's negatives are the best rows of other labels that score from
    ``percent`` / 100 of the positive's score to that score.
    """
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    some = rows.where(usable).where(~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    some = saved(some.withColumn("key", F.xxhash64("vector", "label")))
    same_class = ["key", "label", "vector"]
    # the hash leads, so vectors are compared only where it agrees
    least = Window.partitionBy(*same_class).orderBy("id")
    ranked = some.select(*same_class, "id").distinct().withColumn("_rank", F.row_number().over(least)).where(F.col("_rank") <= max(positives + 1, negatives))
    classes = ranked.groupBy(*same_class).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()))
    index = build_index(classes.drop("key"), leaves)

    anchors = saved(some.where("anchor").select(*same_class, F.col("id").alias("anchor_id")).distinct().join(classes.select(*same_class, "cid"), same_class).select("cid", "anchor_id"))
    asked = saved(classes.join(anchors.select("cid").distinct(), "cid", "left_semi").select("cid", "label", "vector"))
    near = asked.withColumns({"lo": F.lit(LOWEST), "hi": F.lit(HIGHEST)})
    more = positives + 1  # the anchor itself may be among them
    bound = raised(near, best_in_windows(index, near, True, more, home=True), more)
    close = saved(best_in_windows(index, bound, True, more, home=False).select("cid", "score", "id"))

    first = Window.partitionBy("anchor_id", "cid").orderBy(F.desc("score"), "id")
    pairs = anchors.join(close, "cid").where(F.col("id") != F.col("anchor_id"))
    pairs = pairs.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= positives)
    pairs = saved(pairs.select("anchor_id", "cid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    windows = asked.join(pairs.select("cid", F.col("positive_score").alias("hi")).distinct(), "cid")
    # the least integer from percent of hi on; div cuts towards zero
    windows = windows.withColumn("lo", F.expr(f"(hi * {int(percent)} + if(hi > 0, 99, 0)) div 100")).where("lo <= hi")
    bound = raised(windows, best_in_windows(index, windows, False, negatives, home=True), negatives)
    apart = saved(best_in_windows(index, bound, False, negatives, home=False))
    order = Window.partitionBy("cid", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    apart = apart.select("cid", F.col("hi").alias("positive_score"), F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    apart = saved(apart.withColumn("rank", F.row_number().over(order)))
    return pairs.join(apart, ["cid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
