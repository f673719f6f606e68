"""Transcript cleaning, encoding and comparison as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..schemas import BLANK, DELIMITER, UNKNOWN

# What the telephone transcripts replace, in order.
CALL_REPLACEMENTS = (("{speaking on another phone}", " "), ("3e", "e"), ("uh-huh", " "), ("uh", " "))
CALL_PUNCTUATION = '"-.,!?#()'
# Annotation patterns of the evaluation transcripts and what replaces them, in order.
ANNOTATIONS = (
    (r"\*\*&?.+?\*\*", ""), (r"\{.+?\}", ""), (r"\[\[.+?\]\]", ""), (r"\[.+?\]", ""), (r"<.+?>", ""), (r"&", ""),
    (r"\w+?-", " "), (r"%\w+", " "), (r"\(\(.+?\)\)?", ""), (r"\?", " "), (r"\.", " "), (r",", " "), (r"--", " "), (r"//", " "), (r"\s{2,}", " "),
)


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def english_letters(text: Column) -> Column:
    """Lower-cased, with letters a-z, apostrophes and blanks only."""
    return F.regexp_replace(F.lower(text), "[^ 'a-z]+", "")


def clean_call(text: Column, whole_words: bool = False) -> Column:
    """Telephone transcript without fillers and punctuation; blanks are tidied only if something changed.

    By default fillers go inside words too; ``whole_words`` keeps those.
    """
    out = text
    for old, new in CALL_REPLACEMENTS:
        out = F.regexp_replace(out, rf"\b{old}\b", new) if whole_words and old.startswith("uh") else F.replace(out, F.lit(old), F.lit(new))
    out = F.translate(out, CALL_PUNCTUATION, " " * len(CALL_PUNCTUATION))
    return F.when(out == text, text).otherwise(F.trim(F.regexp_replace(out, " {2,}", " ")))


def clean_annotations(text: Column) -> Column:
    out = F.lower(text)
    for pattern, new in ANNOTATIONS:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def clean_sentence_id(raw: Column) -> Column:
    """Without up to two leading @, then up to two leading *."""
    return F.regexp_replace(F.regexp_replace(raw, r"^@{1,2}", ""), r"^\*{1,2}", "")


def encode(text: Column, index: Column) -> Column:
    """Vocabulary indices of the characters; ``index`` maps characters to indices, blanks are the delimiter."""
    characters = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("|")), ""), lambda c: c != "")
    return F.transform(characters, lambda c: F.when(c == "|", F.lit(DELIMITER)).otherwise(F.coalesce(F.try_element_at(index, c), F.lit(UNKNOWN))))


def collapse(indices: Column, blank: int = BLANK) -> Column:
    """Indices without repeats of their neighbour, then without blanks."""
    kept = F.filter(indices, lambda x, i: (i == 0) | (x != F.get(indices, i - 1)))
    return F.filter(kept, lambda x: x != blank)


def best_path(logits: Column, valid_len: Column | None = None) -> Column:
    """Index of the greatest logit of each valid frame (0-based); null length: all frames."""
    frames = logits if valid_len is None else F.slice(logits, 1, F.coalesce(valid_len, F.size(logits)))
    return F.transform(frames, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def decode(indices: Column, characters: Column) -> Column:
    """Text of indices; ``characters`` is an array in index order, special tokens other than the delimiter are dropped."""
    text = F.transform(F.filter(indices, lambda i: i >= DELIMITER), lambda i: F.when(i == DELIMITER, F.lit(" ")).otherwise(F.get(characters, i)))
    return F.trim(F.array_join(text, ""))


def none_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit("none"))


def padded_id(n: Column, width: int = 6) -> Column:
    return F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0"))


def tokens(text: Column) -> Column:
    """Words between white space; none for null and blank texts."""
    body = single_spaced(F.coalesce(text, F.lit("")))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))


def edit_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Substitutions, deletions and insertions between two sequences.

    A column of the edit table is two integers with a bit per element of ``a``, so a
    step costs a few operations on whole columns. Of long sequences only the rows near the
    diagonal are kept, as many as the distance turns out to need.
    """
    long = max(len(a), len(b))
    band = long if long <= 512 else max(64, long // 16)
    while True:
        distance = _banded(a, b, band)
        if distance <= band or band >= long:
            return distance
        band *= 2


def _banded(a: Sequence[str], b: Sequence[str], band: int) -> int:
    """The edit distance where it is at most ``band``, else a number above.

    Alignments leave the diagonal by their cost at most. So columns are taken in stretches, for
    which only the rows less than ``band`` beside them are there; the values outside are bounded from above.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return m or n
    step = n if band >= max(m, n) else 2 * band
    low, high, up, down, edge = 0, 0, 0, 0, 0  # rows that are there, differences between them, value above them
    for first in range(0, n, step):
        last = min(first + step, n)
        drop, new = max(0, min(m, first - band) - low), m if last == n else max(high, min(m, last + band))
        if low + drop >= high and high:
            return max(m, n) + 1  # the rows of the stretch lie below those that are known
        gone = (1 << drop) - 1
        edge += (up & gone).bit_count() - (down & gone).bit_count() + last - first
        up, down, low = up >> drop | (1 << new - high) - 1 << high - low - drop, down >> drop, low + drop
        high = new
        places: dict[str, int] = {}
        for i, x in enumerate(a[low:high]):
            places[x] = places.get(x, 0) | 1 << i
        full = (1 << high - low) - 1
        for y in b[first:last]:
            same = places.get(y, 0)
            vertical = same | down
            horizontal = ((same & up) + up ^ up) | same
            plus, minus = down | full & ~(horizontal | up), up & horizontal
            plus, minus = plus << 1 | 1, minus << 1
            up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return edge + up.bit_count() - down.bit_count()


@F.pandas_udf(LongType())
def _word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(r.split(), h.split()) for r, h in zip(ref, hyp)], dtype="int64")


def word_edit_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance between the words of two texts, null counting as empty; in Arrow batches.

    Measured faster than an edit table folded with array functions.
    """
    words = lambda c: single_spaced(F.coalesce(c, F.lit("")))
    return _word_distance(words(ref), words(hyp))
