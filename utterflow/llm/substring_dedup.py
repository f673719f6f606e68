"""Substring deduplication: content-defined paragraphs of two sizes, MinHash banding, growth word by word.

A text is cut into long paragraphs where the hash of a word pair is the least among its
neighbours, so the cuts inside a passage depend on the passage alone. Long paragraphs whose
signatures share a band are verified on their exact sets of ``shingle`` words, and of each
component of paragraphs of Jaccard ``percent`` / 100 or more, equal ones included, the
first one stays (least document, then place).

Long paragraphs alone miss passages that hold none as a whole, the words beside the borders
of a passage, and short stretches between edits. So a second size covers the text more
densely: a short paragraph is SEED words from a content-defined place, the least of
REACH + 1 successive ones, so a passage of SEED + REACH words or more brings short paragraphs
along wherever it lies. At a Jaccard of 0.8, sets of so few shingles are similar only if
they are equal, so one band, the whole paragraph, finds all pairs. Short paragraphs that an
earlier place has too, on one alignment, form runs, and runs grow word by word on both
sides while the words of both places agree, up to REACH words. Two runs with the same
earlier document and at most GAP words between them, in both documents, are bridged:
their edit distance is at most a fifth of their length. Repeated words are removable where
they run for ``min_words`` words or more; shorter runs, such as common lines, stay. Each
removed word is in a stretch of SEED words or more that one earlier document has, or in a
similar paragraph or a bridge; neighbouring stretches may have different earlier documents.
Every word of a repeated passage of SEED + REACH words is covered, but for up to REACH words
at a border beside a short paragraph that a third, earlier document has in other company.

Cases: a null or blank text has no paragraphs, and a paragraph of fewer than SEED words, as
at a text's end, is compared with none; equal texts repeat each other as a whole; rows
that repeat an id, and rows with a null id, are documents of their own (null last); a
stretch that overlaps its own first place is no repeat; an empty table gives an empty
result. Whole texts are taken, of up to 2^27 words, and more raise an error; columns
besides id and text are ignored. Hashes of 64 bits stand for paragraphs, and of 31 bits
for the words beside a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import discard, release
from .components import batches_of, buckets_with_company, linked_components
from .frames import free_name, numbered, saved, unique_ids
from .kernels import band_keys, chunks, list_array, shingle_sets, superminhash, window_hashes, word_table
from .near_dedup import set_fingerprints

#: Words of a short paragraph, which is the least of REACH + 1 successive ones; words between two runs that are bridged.
SEED, REACH, GAP = 10, 10, 6
#: Words on each side among which a cut is the least: paragraphs have about 2 HALF + 1 words.
HALF, LONGEST = 31, 256
#: Bands x rows. A pair of paragraphs of Jaccard 0.8 shares none in 6 of 1,000 cases, one of 0.9 in 2 of 10,000.
BANDS, ROWS = 5, 2
#: Bits of a word's place in its text; a document's number stands above them.
BITS = 27

SEED_ROW, BAND_ROW, PARAGRAPH_ROW = 0, 1, 2


def paragraph_starts(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every paragraph, and its row. A stretch without a cut ends after LONGEST words."""
    n = len(hashes)
    pair = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    pair[: max(0, n - 1)] = window_hashes(hashes, 2)
    cut = np.ones(n, bool)
    for k in range(1, HALF + 1):
        cut[k:] &= pair[k:] < pair[:-k]
        cut[:-k] &= pair[:-k] <= pair[k:]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(n) - bounds[:-1][row]
    left = bounds[1:][row] - np.arange(n)
    cut &= (place >= HALF) & (left > HALF)
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, n))
    pieces = -(-sizes // LONGEST)
    if (pieces > 1).any():
        again = np.repeat(starts, pieces)
        step = np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = again + step * LONGEST
    return starts, row[starts]


def seed_places(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the short paragraphs: the leftmost least of every REACH + 1 successive stretches of SEED words."""
    grams = window_hashes(hashes, SEED)
    n = max(0, len(grams) - REACH)
    least = grams[:n].copy()
    for k in range(1, REACH + 1):
        np.minimum(least, grams[k : k + n], out=least)
    where = np.zeros(n, np.int64)
    for k in range(REACH, -1, -1):
        where[grams[k : k + n] == least] = k
    at = np.arange(n)
    row = np.searchsorted(bounds, at, "right") - 1
    inside = at + REACH + SEED <= bounds[row + 1]
    chosen = np.zeros(len(grams), bool)
    chosen[(at + where)[inside]] = True
    at = np.flatnonzero(chosen)
    return at, grams[at]


def set_classes(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    a, b = set_fingerprints(flat, ends)
    return a ^ (b << 1)


def marks(texts: DataFrame, shingle: int) -> DataFrame:
    """``kind, key, value, n`` of (num, text), flat rows.

    A short paragraph gives (hash, place), a band of a paragraph (band, class), a long paragraph
    (class, place) and its number of words; a place is a document's number and a word's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nums = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in chunks(batch.column(1)):
                hashes, bounds, _, _ = word_table(data, offsets)
                if len(hashes) and np.diff(bounds).max() >= 1 << BITS:
                    raise ValueError(f"a text has {np.diff(bounds).max()} words; up to 2^{BITS} are handled")
                base = (nums[first:end] << BITS) - bounds[:-1]
                at, seed = seed_places(hashes, bounds)
                seed_row = np.searchsorted(bounds, at, "right") - 1
                starts, row = paragraph_starts(hashes, bounds)
                limits = np.append(starts, len(hashes))
                flat, ends = shingle_sets(hashes, limits, shingle)
                long = np.flatnonzero(np.diff(limits) >= SEED)
                name = set_classes(flat, ends)[long]
                # equal paragraphs of a chunk have one signature
                _, once = np.unique(name, return_index=True)
                sizes = np.diff(ends)[long[once]]
                inner = np.concatenate(([0], np.cumsum(sizes)))
                elements = flat[np.arange(inner[-1]) - np.repeat(inner[:-1] - ends[long[once]], sizes)]
                bands = band_keys(superminhash(elements, inner, BANDS * ROWS), BANDS, ROWS).reshape(-1).view(np.int64)
                parts = (
                    (SEED_ROW, seed.view(np.int64), base[seed_row] + at, np.zeros(len(at), np.int32)),
                    (BAND_ROW, bands, np.repeat(name[once], BANDS), np.zeros(len(bands), np.int32)),
                    (PARAGRAPH_ROW, name, (base[row] + starts)[long], np.diff(limits)[long].astype(np.int32)),
                )
                for kind, key, value, n in parts:
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(value), pa.array(n)], ["kind", "key", "value", "n"])

    return texts.select("num", "text").mapInArrow(run, "kind tinyint, key long, value long, n int")


def paragraph_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``id, n, set``: class and shingles of the paragraphs that start at the words ``starts`` of (text, starts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            for first, end, data, offsets in chunks(batch.column(0)):
                hashes, bounds, _, _ = word_table(data, offsets)
                starts, _ = paragraph_starts(hashes, bounds)
                limits = np.append(starts, len(hashes))
                own = np.concatenate([np.asarray(wanted[first + r].values, np.int64) + bounds[r] for r in range(end - first)])
                at = np.searchsorted(starts, own)
                sizes = limits[at + 1] - limits[at]
                inner = np.concatenate(([0], np.cumsum(sizes)))
                flat, ends = shingle_sets(hashes[np.arange(inner[-1]) - np.repeat(inner[:-1] - limits[at], sizes)], inner, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(set_classes(flat, ends)), pa.array(np.diff(ends)), list_array(flat, ends)], ["id", "n", "set"])

    return texts.select("text", "starts").mapInArrow(run, "id long, n long, set array<long>")


def _doc(place: str | Column) -> Column:
    return F.shiftright(place, BITS)


def _word(place: str | Column) -> Column:
    return (F.col(place) if isinstance(place, str) else place).bitwiseAND(F.lit((1 << BITS) - 1))


def similar_paragraphs(texts: DataFrame, found: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``start, stop, kept`` (places): paragraphs that are not the first of their component, and the first. Equal paragraphs are one class."""
    company = saved(buckets_with_company(found.where(F.col("kind") == BAND_ROW).select(F.col("key").alias("band"), F.col("value").alias("id")).distinct()))
    paragraphs = found.where(F.col("kind") == PARAGRAPH_ROW).select(F.col("key").alias("id"), F.col("value").alias("start"), "n")

    def fetch(ids: DataFrame) -> DataFrame:
        one = paragraphs.join(saved(ids), "id", "left_semi").groupBy("id").agg(F.min("start").alias("start"))
        wanted = one.groupBy(_doc("start").alias("num")).agg(F.collect_list(_word("start")).alias("starts"))
        return paragraph_sets(texts.join(wanted, "num"), shingle)

    linked = linked_components(company, fetch, percent)
    discard(company)
    placed = paragraphs.join(linked, "id", "left").select(F.coalesce("component", "id").alias("component"), "start", (F.col("start") + F.col("n")).alias("stop"))
    placed = saved(placed)
    kept = placed.groupBy("component").agg(F.min("start").alias("kept"), F.max("start").alias("_last")).where(F.col("kept") != F.col("_last"))
    # written first, so that Spark can split the rows of a common paragraph
    out = saved(placed.join(saved(kept.drop("_last")), "component").where(F.col("start") != F.col("kept")).select("start", "stop", "kept"))
    discard(placed)
    release(texts.sparkSession)
    return out


def seed_runs(found: DataFrame) -> DataFrame:
    """``start, stop, kept`` (places): the runs of short paragraphs that an earlier place has, on one alignment each.

    First places come from partial aggregation and are joined back, so no group of equal
    ones has to meet in one task.
    """
    seeds = found.where(F.col("kind") == SEED_ROW).select("key", F.col("value").alias("place"))
    first = seeds.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("_last"))
    first = saved(first.where(F.col("first") != F.col("_last")).drop("_last"))
    release(found.sparkSession)
    later = seeds.join(first, "key").select("place", (F.col("place") - F.col("first")).alias("shift"), "first")
    later = later.where((F.col("shift") > 0) & ((_doc("place") != _doc("first")) | (F.col("shift") >= SEED)))
    # alignments keep to one document by its number, and a run never leaves a document
    line = Window.partitionBy(_doc("place"), "shift").orderBy("place")
    new = F.coalesce((F.col("place") - F.lag("place").over(line) > SEED).cast("int"), F.lit(1))
    runs = later.select("place", "shift", new.alias("_new")).withColumn("_run", F.sum("_new").over(line))
    runs = runs.groupBy(_doc("place").alias("_doc"), "shift", "_run").agg(F.min("place").alias("start"), (F.max("place") + SEED).alias("stop"))
    return runs.select("start", "stop", (F.col("start") - F.col("shift")).alias("kept"))


def surroundings(texts: DataFrame) -> DataFrame:
    """``side, place, stop, words`` of the places listed in ``asked`` (side, a, b) of (num, text, asked).

    Side 0 is a run from word a to word b: the hashes of REACH words before a, going left,
    and of as many from b on. Sides 1 and 2 are words of the earlier place that are to be
    compared: those before a, and those from a on. Where a text ends, words are -1, or -2 for
    side 0.
    """
    step = np.arange(REACH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            for first, end, data, offsets in chunks(batch.column(1)):
                hashes, bounds, _, _ = word_table(data, offsets)
                short = ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0x7FFFFFFF)).astype(np.int32)
                items = asked.slice(first, end - first)
                counts = np.diff(items.offsets.to_numpy())
                items = items.flatten()
                row = np.repeat(np.arange(end - first), counts)
                side, a, b = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                low, high = bounds[row], bounds[row + 1]
                own = side == 0

                def around(at: np.ndarray) -> np.ndarray:
                    inside = (at >= low[:, None]) & (at < high[:, None])
                    return np.where(inside, short[np.clip(at, 0, len(short) - 1)], np.where(own, -2, -1)[:, None]).astype(np.int32)

                before, after = around((low + a)[:, None] - 1 - step), around((low + np.where(own, b, a))[:, None] + step)
                words = np.concatenate((np.where((side == 2)[:, None], after, before), after), axis=1)
                sizes = np.where(own, 2 * REACH, REACH)
                base = batch.column(0).to_numpy(zero_copy_only=False)[first:end][row] << BITS
                lists = list_array(words[np.arange(2 * REACH) < sizes[:, None]], np.concatenate(([0], np.cumsum(sizes))))
                yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int8)), pa.array(base + a), pa.array(base + b), lists], ["side", "place", "stop", "words"])

    return texts.select("num", "text", "asked").mapInArrow(run, "side tinyint, place long, stop long, words array<int>")


def grown(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` (start, stop, kept) grown, on both sides, to the words that agree."""
    kept_stop = F.col("kept") + F.col("stop") - F.col("start")
    place = lambda side, a, b: runs.select(F.lit(side).cast("tinyint").alias("side"), a.alias("place"), b.alias("stop"))
    asked = place(0, F.col("start"), F.col("stop")).unionByName(place(1, F.col("kept"), F.col("kept"))).unionByName(place(2, kept_stop, kept_stop)).distinct()
    asked = asked.groupBy(_doc("place").alias("num")).agg(F.collect_list(F.struct("side", _word("place").alias("a"), _word("stop").alias("b"))).alias("asked"))
    around = saved(surroundings(texts.join(asked, "num")))
    release(texts.sparkSession)
    mine = around.where("side = 0").select(F.col("place").alias("start"), "stop", F.col("words").alias("_mine"))
    left = around.where("side = 1").select(F.col("place").alias("kept"), F.col("words").alias("_left"))
    right = around.where("side = 2").select(F.col("place").alias("_kept_stop"), F.col("words").alias("_right"))
    same = lambda a, b: F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x == y), False), F.lit(0)) - 1, F.lit(REACH))
    joined = runs.withColumn("_kept_stop", kept_stop).join(mine, ["start", "stop"])
    joined = joined.join(left, "kept").withColumn("_back", same(F.slice("_mine", 1, REACH), F.col("_left"))).drop("_left")
    joined = joined.withColumn("_mine", F.slice("_mine", REACH + 1, REACH)).join(right, "_kept_stop").withColumn("_on", same(F.col("_mine"), F.col("_right")))
    grown_ = joined.select((F.col("start") - F.col("_back")).alias("start"), (F.col("stop") + F.col("_on")).alias("stop"), (F.col("kept") - F.col("_back")).alias("kept"))
    out = saved(grown_)
    discard(around)
    release(texts.sparkSession)
    return out


def bridges(runs: DataFrame) -> DataFrame:
    """The stretches of at most GAP words between two runs (start, stop, kept) of one document with one earlier document, where it has as few."""
    exact = runs.select("start", "stop", "kept", (F.col("kept") + F.col("stop") - F.col("start")).alias("kept_stop"))
    pair = Window.partitionBy(_doc("start"), _doc("kept")).orderBy("start", "stop", "kept")
    gaps = exact.select("*", F.lag("stop").over(pair).alias("_stop"), F.lag("kept_stop").over(pair).alias("_kept_stop"))
    near = (F.col("start") - F.col("_stop")).between(1, GAP) & (F.col("kept") - F.col("_kept_stop")).between(0, GAP)
    return gaps.where(near).select(F.col("_stop").alias("start"), F.col("start").alias("stop"), F.col("_kept_stop").alias("kept"))


def _repeats(texts: DataFrame, percent: int, min_words: int, shingle: int) -> DataFrame:
    """``num, first_word, n_words, n_paragraphs, of`` of the removable spans of (num, text)."""
    found = saved(marks(texts, shingle))
    similar = similar_paragraphs(texts, found, percent, shingle)
    runs = saved(seed_runs(found))
    discard(found)
    release(texts.sparkSession)
    runs = grown(texts, runs)
    parts = runs.unionByName(bridges(runs)).withColumn("paragraph", F.lit(0)).unionByName(similar.withColumn("paragraph", F.lit(1)))
    # words that overlap or touch are one run
    order = Window.partitionBy(_doc("start")).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    lined = parts.withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    lined = lined.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lined.groupBy(_doc("start").alias("num"), "_run").agg(
        _word(F.min("start")).alias("first_word"), (F.max("stop") - F.min("start")).alias("n_words"), F.sum("paragraph").alias("n_paragraphs"), F.collect_set(_doc("kept")).alias("of"),
    )
    return saved(spans.where(F.col("n_words") >= min_words).drop("_run"))


def _with_bytes(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with first_byte and end_byte, from the texts that have any."""
    wanted = spans.groupBy("num").agg(F.collect_list(F.struct("first_word", "n_words", "n_paragraphs", "of")).alias("spans"))
    names = ["num", "first_word", "n_words", "n_paragraphs", "of", "first_byte", "end_byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                _, bounds, word_start, word_end = word_table(data, offsets)
                items = batch.column(2).slice(first, end - first)
                row = np.repeat(np.arange(end - first), np.diff(items.offsets.to_numpy()))
                items = items.flatten()
                at, n = (items.field(k).to_numpy() for k in (0, 1))
                bytes_ = word_start[bounds[row] + at] - offsets[row], word_end[bounds[row] + at + n - 1] - offsets[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), *(items.field(k) for k in range(4)), *map(pa.array, bytes_)], names)

    schema = "num long, first_word long, n_words long, n_paragraphs long, of array<long>, first_byte long, end_byte long"
    return texts.join(wanted, "num").select("num", "text", "spans").mapInArrow(run, schema)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, min_words: int = 20, shingle: int = 5, with_bytes: bool = True,
) -> DataFrame:
    """One row per removable span: id, first_word, n_words, n_paragraphs, kept_doc_ids and, ``with_bytes``, first_byte and end_byte.

    Bytes are of the text in UTF-8 and cost another pass; ``n_paragraphs`` counts the long
    paragraphs in it that are similar or equal to earlier ones, 0 where short ones alone make the span. ``kept_doc_ids`` are the
    documents that keep the earlier places.
    """
    texts, plain = _numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    spans = _repeats(texts, percent, min_words, shingle)
    columns = ["first_word", "n_words", "n_paragraphs"] + ["first_byte", "end_byte"] * with_bytes
    full = _with_bytes(texts, spans) if with_bytes else spans
    if plain:
        kind = docs.schema[id_col].dataType
        return full.select(F.col("num").cast(kind).alias(id_col), *columns, F.array_sort("of").cast(f"array<{kind.simpleString()}>").alias("kept_doc_ids"))
    ids = saved(texts.select("num", "doc"))
    names = spans.select("num", "first_word", F.explode("of").alias("_kept")).join(ids.select(F.col("num").alias("_kept"), F.col("doc").alias("_name")), "_kept")
    names = names.groupBy("num", "first_word").agg(F.array_sort(F.collect_set("_name")).alias("kept_doc_ids"))
    return full.join(names, ["num", "first_word"]).join(ids, "num").select(F.col("doc").alias(id_col), *columns, "kept_doc_ids")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of all spans (id, first_word, n_words), and what stands between them, cut out of their texts.

    Other columns and rows stay as they are, and so do rows without a span, also those with a
    null text or id. Ids must tell rows apart.
    """
    cut, list_ = free_name(docs, "_cut"), free_name(docs, "_spans")
    cuts = spans.groupBy(F.col(id_col).alias(cut)).agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias(list_))
    joined = docs.join(cuts, docs[id_col] == cuts[cut], "left").drop(cut)
    names = docs.columns
    text_at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(len(names))
        texts = batch.column(text_at)
        wanted = pc.and_(lists.is_valid(), texts.is_valid())
        at = np.flatnonzero(wanted.to_numpy(zero_copy_only=False))
        new = []
        for first, end, data, offsets in chunks(texts.take(pa.array(at))):
            _, bounds, word_start, word_end = word_table(data, offsets)
            raw = data.tobytes()
            for r in range(end - first):
                parts, done = [], int(offsets[r])
                for span in lists[int(at[first + r])].as_py():
                    a = int(bounds[r]) + span["first_word"]
                    parts.append(raw[done : word_start[a]])
                    done = int(word_end[a + span["n_words"] - 1])
                new.append(b"".join([*parts, raw[done : offsets[r + 1]]]).decode())
        columns = batch.columns[: len(names)]
        columns[text_at] = pc.replace_with_mask(texts, wanted, pa.array(new, texts.type))  # other texts stay as they are in Arrow
        return pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(batches_of(run), docs.schema)


def _numbered(texts: DataFrame) -> tuple[DataFrame, bool]:
    """(num, doc, text) of (doc, text), and whether ``num`` is the id itself; numbers follow the order of the ids."""
    if texts.schema["doc"].dataType.typeName() in ("byte", "short", "integer", "long") and unique_ids(texts, "doc"):
        low, high = texts.agg(F.min("doc"), F.max("doc")).first()
        if low is None or (low >= 0 and high < 1 << (63 - BITS)):
            return texts.select(F.col("doc").cast("long").alias("num"), "doc", "text"), True
    return numbered(texts, "doc", "text", "num"), False
