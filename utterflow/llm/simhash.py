"""SimHash near-duplicates by anchor-point covering: fingerprints meet at codewords near them.

The anchors are the codewords of a covering code over the fingerprint's low 46 bits: two
blocks of the perfect binary Golay code of 23 bits and radius 3. So each fingerprint has
one anchor within radius 3 in either block, its home. If y differs from x in ``distance``
bits, y is within 3 + e1 and 3 + e2 of x's home, with e1 + e2 at most ``distance``. Each
fingerprint is replicated to all those anchors (about 61 for 2 bits), and at an anchor the
fingerprints whose home it is are compared, on all 64 bits, with all that reach it. Every
pair of fingerprints that are near enough meets at the homes of both; one is kept. A
fingerprint has at most 2,080 others within 2 bits, so links grow with the fingerprints
and never with the square of a group; equal fingerprints fold into one before.

Cases: a null or blank text has the fingerprint zero and is linked like any other; a text
of fewer words than a shingle is one shingle; rows that repeat an id are one node with
all their fingerprints; a row with a null id links others as any row does, and the
component's id is the least id that is not null, or null; an empty table gives an empty
result. Whole texts are taken; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import batches_of, connected_components
from .frames import saved
from .kernels import ASCII_LOWER, chunks, word_spans

#: Length, covering radius and generator polynomial of the binary Golay code.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b110001110101
#: First bits of the blocks of a fingerprint that the code covers.
BLOCKS = (0, 23)
SEED = 42
#: Rows of anchors that a task makes at once.
ANCHOR_ROWS = 1 << 16


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another with a single space behind each, and where each begins; one more start than words."""
    sizes = ends - starts
    places = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(places[-1], 32, np.uint8)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(places[:-1], sizes) + inner] = data[np.repeat(starts, sizes) + inner]
    return out, places


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """SimHash of each row: a bit is 1 if it is set in over half the XXH64 of the row's shingles, repeats included."""
    starts, ends, row = word_spans(data, offsets)
    text, places = joined_words(ASCII_LOWER[data], starts, ends)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    words = np.diff(bounds)
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    first = np.repeat(bounds[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(n.sum())
    last = np.minimum(first + shingle, np.repeat(bounds[some + 1], n[some]))
    view, digest = memoryview(text), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(places[first].tolist(), (places[last] - 1).tolist())], np.uint64)
    at = np.cumsum(n[some]) - n[some]
    # bits of a slice of rows at a time: 64 bytes a shingle
    for a, b in _slices(n[some]):
        inside = hashes[at[a] : at[b - 1] + n[some[b - 1]]]
        ones = np.unpackbits(inside.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(ones, at[a:b] - at[a], axis=0, dtype=np.int32)
        out[some[a:b]] = np.packbits(2 * count > n[some[a:b], None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _slices(sizes: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` shingles in all, or of one row."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
        yield a, b
        a = b


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` of every row; fp is the 64-bit fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [fingerprints_of(data, offsets, shingle) for _, _, data, offsets in chunks(batch.column(1))]
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat.view(np.int64))], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(batches_of(run), f"id {kind}, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial, its syndrome."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - 13, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@lru_cache(maxsize=4)
def error_patterns(distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each excess e: patterns that lead from a word to the codewords at radius + e, by syndrome, and their bounds.

    Excess 0 holds all patterns of weight up to the radius; as the code is perfect, each
    syndrome has one of them.
    """
    patterns, bounds = [], []
    for excess in range(distance + 1):
        weights = range(RADIUS + 1) if not excess else [RADIUS + excess]
        found = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.int64)
        syndrome = _remainders(found)
        patterns.append(found[np.argsort(syndrome, kind="stable")])
        bounds.append(np.concatenate(([0], np.cumsum(np.bincount(syndrome, minlength=1 << 11)))))
    return patterns, bounds


def _block(fps: np.ndarray, k: int) -> np.ndarray:
    return ((fps >> np.uint64(BLOCKS[k])) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)


def home_anchors(fps: np.ndarray) -> np.ndarray:
    """The one anchor within the covering radius of each fingerprint."""
    patterns, _ = error_patterns(0)
    low, high = ((w := _block(fps, k)) ^ patterns[0][_remainders(w)] for k in (0, 1))
    return low | high << LENGTH


def anchors_within(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all anchors within radius and ``distance`` of each fingerprint, each once."""
    patterns, bounds = error_patterns(distance)
    low, high = _block(fps, 0), _block(fps, 1)
    s_low, s_high = _remainders(low), _remainders(high)
    rows, anchors = [], []
    for e in range(distance + 1):
        for f in range(distance + 1 - e):
            n_low, n_high = np.diff(bounds[e])[s_low], np.diff(bounds[f])[s_high]
            n = n_low * n_high
            row = np.repeat(np.arange(len(fps)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = patterns[e][bounds[e][s_low[row]] + k // np.maximum(n_high[row], 1)]
            b = patterns[f][bounds[f][s_high[row]] + k % np.maximum(n_high[row], 1)]
            rows.append(row)
            anchors.append((low[row] ^ a) | (high[row] ^ b) << LENGTH)
    return np.concatenate(rows), np.concatenate(anchors)


def fingerprint_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """``a, b``: every pair of the distinct fingerprints ``fp`` that differ in 1 to ``distance`` bits, once."""

    def homes(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(home_anchors(fps.view(np.uint64))), batch.column(0)], ["anchor", "a"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ANCHOR_ROWS >> 6)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), step):
                row, anchor = anchors_within(fps[k : k + step].view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[k + row])], ["anchor", "b"])

    at_home = distinct.select("fp").mapInArrow(batches_of(homes), "anchor long, a long")
    reaching = distinct.select("fp").mapInArrow(reach, "anchor long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # Spark takes both sides for as large as the fingerprints, so it would broadcast one; neither has a bound
    return at_home.join(reaching.hint("merge"), "anchor").where(near).select("a", "b")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3) -> DataFrame:
    """Id, fingerprint (16 hex digits) and component_id of every row.

    Rows fold into distinct fingerprints by partial aggregation before anything is
    replicated, so a group of equal fingerprints of any size costs one.
    """
    sketch = saved(fingerprints(docs, id_col, text_col, shingle))
    classes = saved(sketch.groupBy("fp").agg(F.min("id").alias("least")))
    links = fingerprint_links(classes, distance)
    # all fingerprints of one id are one node
    spread = sketch.where("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("_z")).where(F.col("a") != F.col("_z"))
    spread = sketch.join(saved(spread.select("id", "a")), "id").select("a", F.col("fp").alias("b")).where("a <> b")
    joined = connected_components(links.unionByName(spread)).select(F.col("id").alias("fp"), "component")
    placed = saved(classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = saved(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    named = saved(placed.join(least, "component").select("fp", "component_id"))
    # written first, so that Spark can split the rows of a common fingerprint
    return sketch.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
