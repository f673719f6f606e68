"""Near-duplicate documents by SuperMinHash, banding, exact verification and components.

Cases: a null or blank text has no shingles and is linked with nothing, itself its
component; a text of fewer words than a shingle is one shingle; equal texts, and
texts with one set, are one class and verified once; rows with one id are one node;
rows with a null id stay with null component and are kept; an empty table gives an
empty result. Whole texts are taken; columns besides id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import discard
from .components import batches_of, buckets_with_company, linked_components
from .frames import saved
from .kernels import band_keys, chunks, list_array, mix, shingle_sets, superminhash, word_table

#: Bands x rows of the signature. A pair of Jaccard 0.85 shares a band but for 4 in 10 million, one of 0.3 in 6 of 100.
BANDS, ROWS = 25, 5


def set_fingerprints(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; equal for equal sets."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5) -> DataFrame:
    """``id, n_shingles, fa, fb, bands`` of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, fa, fb, keys = [], [], [], []
        for _, _, data, offsets in chunks(batch.column(1)):
            hashes, bounds, _, _ = word_table(data, offsets)
            flat, ends = shingle_sets(hashes, bounds, shingle)
            a, b = set_fingerprints(flat, ends)
            n.append(np.diff(ends))
            fa.append(a)
            fb.append(b)
            keys.append(band_keys(superminhash(flat, ends, BANDS * ROWS), BANDS, ROWS))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        keys = join(keys, np.uint64).reshape(-1)
        bands = list_array(keys, np.arange(len(batch) + 1) * BANDS)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(join(n, np.int64)), pa.array(join(fa, np.int64)), pa.array(join(fb, np.int64)), bands], ["id", "n_shingles", "fa", "fb", "bands"])

    return docs.select(id_col, text_col).mapInArrow(batches_of(run), f"id {kind}, n_shingles long, fa long, fb long, bands array<long>")


def text_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``id, n, set`` of the shingles of each (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flats, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, _, data, offsets in chunks(batch.column(1)):
            hashes, bounds, _, _ = word_table(data, offsets)
            flat, ends = shingle_sets(hashes, bounds, shingle)
            flats.append(flat)
            sizes.append(np.diff(ends))
        n = np.concatenate(sizes)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), list_array(np.concatenate(flats), np.concatenate(([0], np.cumsum(n))))], ["id", "n", "set"])

    return docs.select("id", "text").mapInArrow(batches_of(run), f"id {kind}, n long, set array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = 5) -> DataFrame:
    """Id, n_shingles, component_id and kept of every row.

    Texts with equal sets fold into one class first, by partial aggregation, so a group
    of exact copies of any size costs one member. Classes that share a band are
    candidates; links are confirmed on full sets.
    """
    sketch = saved(sketches(docs, id_col, text_col, shingle))
    some = sketch.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = some.groupBy("fa", "fb", "n_shingles").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # written first, so that Spark can split the rows of a large group of copies
    member = some.join(saved(classes), ["fa", "fb", "n_shingles"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "bands")
    member = saved(member.withColumn("bands", F.when(F.col("id") == F.col("rep"), F.col("bands"))))
    bands = member.where(F.col("id") == F.col("rep")).select("id", F.explode("bands").alias("band")).distinct()
    company = saved(buckets_with_company(bands))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # of rows that repeat an id, the sets of all are verified under that id
    linked = linked_components(company, lambda ids: text_sets(texts.join(ids, "id", "left_semi"), shingle), percent).withColumnRenamed("id", "rep")
    discard(company)
    found = member.select("id", "rep").distinct().join(linked, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    found = found.groupBy("id").agg(F.min("component").alias("component"))
    out = sketch.select("id", "n_shingles").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
