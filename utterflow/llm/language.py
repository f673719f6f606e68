"""Language identification with bit-sliced Bloom filters of letter n-grams.

One table of masks holds a Bloom filter for every language: bit l % 64 of word l // 64 of a
slot belongs to language l. A lookup of an n-gram takes the AND of its slots and returns all
languages that contain it. A text's n-grams give a count per language; each count is
corrected for the share of false positives that its language's fill leads to, and the
greatest decides.

Cases: a null text, or one without a letter, is ``und`` with score 0; a text whose
n-grams no filter knows gets the most common language and an even score; ties go to the
language more common in training, then the smaller tag; equal rows get equal results, and
rows that repeat an id are trained on each, under their own lang, and equal rows once; there may be any number of
languages; an empty table gives an empty result. Without any training row all texts are
``und``. Whole texts are taken, of any length; columns besides id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import saved
from .kernels import chunks

#: UTF-8 bytes per n-gram; a word is preceded and followed by a blank.
SIZES = (3, 4, 5)
#: 8 MB for each 64 languages.
SLOTS = 1 << 20
#: The fit's bound: labelled rows per language, those with the least hash of id and text.
TRAIN_ROWS = 500

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _normal(texts: pa.Array) -> pa.Array:
    """Lower-cased texts between blanks; null becomes a blank."""
    text = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    blank = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(blank, text, blank, pa.scalar("", pa.large_string()))


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of each row and their bounds; runs of other characters count as one blank."""
    folded = _FOLD[data]
    blank = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    return folded[keep].astype(np.uint64), np.concatenate(([0], np.cumsum(keep)))[offsets]


def grams(bytes_: np.ndarray, size: int) -> np.ndarray:
    """The n-gram that starts at each byte, packed in 64 bits with its size on top; the last ones run on into the next row."""
    n = max(0, len(bytes_) - size + 1)
    out = np.full(n, size << 40, np.uint64)
    for k in range(size):
        out |= bytes_[k : k + n] << np.uint64(8 * k)
    return out


def slots(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of each n-gram."""
    h = packed * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(44)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)


class Filters:
    """The mask table (SLOTS x words of 64 languages), its languages in order of preference, and their false-positive rates."""

    def __init__(self, languages: Sequence[str], table: np.ndarray):
        self.languages, self.table = list(languages), table
        self.false = np.array([np.mean((table[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) ** 2 for b in range(len(self.languages))])

    @classmethod
    def of_grams(cls, grams_of: dict[str, np.ndarray]) -> Filters:
        table = np.zeros((SLOTS, -(-len(grams_of) // 64)), np.uint64)
        for bit, packed in enumerate(grams_of.values()):
            for at in slots(packed):
                table[at, bit // 64] |= np.uint64(1 << bit % 64)
        return cls(list(grams_of), table)

    def masks(self, packed: np.ndarray, word: int) -> np.ndarray:
        """The languages, of 64, that contain each n-gram, as bits."""
        a, b = slots(packed)
        column = np.ascontiguousarray(self.table[:, word]) if self.table.shape[1] > 1 else self.table.reshape(-1)
        return column[a] & column[b]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x languages: n-grams that each language contains, without the expected false positives."""
        bytes_, bounds = letters(data, offsets)
        out, n = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1, np.int64)
        for size in SIZES:
            packed = grams(bytes_, size)
            if not len(packed):
                continue
            first, last = np.minimum(bounds[:-1], len(packed)), np.minimum(np.maximum(bounds[:-1], bounds[1:] - size + 1), len(packed))
            n += last - first
            for bit in range(len(self.languages)):
                if bit % 64 == 0:
                    masks = self.masks(packed, bit // 64)
                total = np.cumsum((masks >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int32)
                upto = lambda at: np.where(at > 0, total[np.maximum(at, 1) - 1], 0)
                out[:, bit] += upto(last) - upto(first)
        return np.maximum(0, (out - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, seen: DataFrame) -> DataFrame:
    """``language, text`` of the sample: of each language the TRAIN_ROWS rows with the least hash of id and text, equal rows once.

    ``seen`` has a row for each language (lang, language, n). A threshold on the hash, from
    the language's row count, leaves about twice as many before they are ranked. The
    sample's hashes are few enough to broadcast, and only its texts are moved.
    """
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    chosen = docs.where(train & F.col(lang_col).isNotNull()).select(hashed.alias("order"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = F.least(F.lit(1.0), F.lit(2.0 * TRAIN_ROWS + 100) / F.col("n")) * float(1 << 40)
    keys = chosen.select("order", "lang").join(F.broadcast(seen), "lang").where(F.pmod("order", F.lit(1 << 40)) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 40)), "order"))
    sample = saved(keys.select("order", "lang", "language").distinct().withColumn("rank", rank).where(F.col("rank") <= TRAIN_ROWS).drop("rank"))
    return chosen.join(F.broadcast(sample), ["order", "lang"]).groupBy("order", "language").agg(F.min("text").alias("text")).select("language", "text")


def fit_language_filters(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of all n-grams of the training sample. Tasks fill tables of a fixed size, and slots meet in an OR.

    The driver holds a row for each language, and the table.
    """
    spark = docs.sparkSession
    counted = docs.where(train & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    seen = [(r["lang"], k, r["n"]) for k, r in enumerate(counted.orderBy(F.desc("n"), "lang").collect())]
    if not seen:
        return Filters([], np.zeros((SLOTS, 0), np.uint64))
    rows = training_rows(docs, id_col, text_col, lang_col, train, spark.createDataFrame(seen, "lang string, language int, n long"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, np.ndarray] = {}
        for batch in batches:
            language = batch.column(0).to_numpy()
            for first, end, data, offsets in chunks(_normal(batch.column(1))):
                bytes_, bounds = letters(data, offsets)
                row = np.repeat(np.arange(end - first), np.diff(bounds))
                for size in SIZES:
                    packed = grams(bytes_, size)
                    at = np.flatnonzero(row[: len(packed)] == row[size - 1 :]) if len(packed) else np.empty(0, np.int64)
                    of = language[first:end][row[at]]
                    for code in np.unique(of).tolist():
                        table = words.setdefault(code // 64, np.zeros(SLOTS, np.uint64))
                        for slot in slots(packed[at[of == code]]):
                            table[slot] |= np.uint64(1 << code % 64)
        for word, table in words.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), word, np.int32)), pa.array(at), pa.array(table[at].view(np.int64))], ["word", "slot", "mask"])

    filled = rows.mapInArrow(fill, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros((SLOTS, -(-len(seen) // 64)), np.uint64)
    table[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters([s[0] for s in seen], table)


def have_letters(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter; only those without an ASCII letter are looked at one by one."""
    known = np.zeros(len(texts), bool)
    for first, end, data, offsets in chunks(texts):
        total = np.concatenate(([0], np.cumsum(_LETTER[data])))
        known[first:end] = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~known).tolist():
        known[k] = any(map(str.isalpha, texts[k].as_py() or ""))
    return known


def identify_languages(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, lang_pred and score of every row; no shuffle. The filters, SLOTS x 8 bytes for each 64 languages, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array(f.languages, object)
        for batch in batches:
            texts = batch.column(1)
            known = have_letters(texts)
            pred, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            for first, end, data, offsets in chunks(_normal(texts)):
                if not f.languages:
                    break
                counts = f.counts(data, offsets)
                total = counts.sum(axis=1)
                best = counts.argmax(axis=1)
                share = np.where(total > 0, counts[np.arange(len(best)), best] / np.where(total > 0, total, 1), 1 / len(f.languages))
                at = np.flatnonzero(known[first:end])
                pred[first + at] = names[best[at]]
                score[first + at] = share[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
