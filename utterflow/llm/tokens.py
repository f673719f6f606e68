"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A text is cut into pre-tokens with array operations on its bytes and a table of
character classes. The distinct pre-tokens of a chunk become one ragged array of
symbols; in each round every sequence applies its own lowest-ranked pair at all its
places at once, until no sequence has a pair left. The symbols that survive are the
tokens. Merging equal pairs together equals the sequential rule because a pair that
involves a new symbol always ranks after the pair that made the symbol.

Cases: a null or empty text has 0 bytes and 0 tokens; equal rows give equal counts;
an empty table gives an empty result; other columns are ignored, whatever their
names. Whole texts are counted, of any length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import chunks, span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Bytes of a pre-token from which on its merges are followed place by place; the counts are the same.
LONG = 256
#: Entries of a worker's table of counted pre-tokens; it is emptied when full.
CACHE_ENTRIES = 1 << 19

# The apostrophe endings that the public pattern takes as pre-tokens.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point as the tokenizer library sees it.

    Letters, numbers and spaces by the Unicode data at hand, then, below U+20000, by
    asking the library's own pre-tokenizer, whose Unicode version may be another.
    """
    from tokenizers import pre_tokenizers

    table = np.zeros(0x110000, np.uint8)
    for start, value in (("L", LETTER), ("N", NUMBER)):
        table[[cp for cp in range(0x110000) if unicodedata.category(chr(cp))[0] == start]] = value
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    points = [cp for cp in range(0x80, 0x20000) if not 0xD800 <= cp < 0xE000]
    for at in range(0, len(points), 8192):
        part = points[at : at + 8192]
        begins = {a for _, (a, _) in cut.pre_tokenize_str("".join(f"\na{chr(cp)}1{chr(cp)}!" for cp in part))}
        for k, cp in enumerate(part):
            joins_letter, joins_digit, joins_mark = 6 * k + 2 not in begins, 6 * k + 3 not in begins, 6 * k + 5 not in begins
            table[cp] = LETTER if joins_letter else NUMBER if joins_digit else OTHER if joins_mark else SPACE
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    return table


class Vocabulary:
    """Merge ranks of a byte-level BPE file, as arrays of ids."""

    def __init__(self, content: str):
        spec = json.loads(content)
        ids = spec["model"]["vocab"]
        # the printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, others follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.of_byte = np.array([ids[stand_in[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.rank))

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols left of each byte span after all merges."""
        out = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(ends - starts > LONG):
            out[k] = self.count_long(self.of_byte[data[starts[k] : ends[k]]])
        short = np.flatnonzero(ends - starts <= LONG)
        starts, sizes = starts[short], (ends - starts)[short].astype(np.int64)
        if not len(starts):
            return out
        sequence = np.repeat(short, sizes)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        symbol = self.of_byte[data[np.arange(sizes.sum()) - np.repeat(first - starts, sizes)]]
        none = len(self.rank)
        while len(symbol):
            rank = np.full(len(symbol), none, np.int64)
            inner = sequence[1:] == sequence[:-1]
            at = np.flatnonzero(inner)
            rank[at] = self.ranks(symbol[at], symbol[at + 1])
            heads = np.flatnonzero(np.concatenate(([True], ~inner)))
            lowest = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.concatenate((heads, [len(symbol)])))
            over = lowest == none
            out[sequence[heads[over]]] = lengths[over]
            least = np.repeat(lowest, lengths)
            hit = (rank == least) & (least < none)
            places = _every_second(np.flatnonzero(hit))
            symbol[places] = self.merged[rank[places]]
            keep = least < none
            keep[places + 1] = False
            symbol, sequence = symbol[keep], sequence[keep]
        return out

    def count_long(self, symbol: np.ndarray) -> int:
        """Symbols left of one long sequence.

        Ranks are taken in order as above, but a round touches only the places of its own
        rank and their neighbours, which are linked: the work follows the merges and not
        the rounds times the length.
        """
        n, none = len(symbol), len(self.rank)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n: behind the end
        symbol, rank = np.append(symbol, 0), np.full(n + 1, none, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Rank the pairs that begin at ``places`` anew and queue them."""
            has = after[places] < n
            rank[places] = none
            places = places[has]
            rank[places] = self.ranks(symbol[places], symbol[after[places]])
            places = places[rank[places] < none]
            places = places[np.argsort(rank[places], kind="stable")]
            of = rank[places]
            cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
            for r, part in zip(of[cuts].tolist(), np.split(places, cuts[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        enter(np.arange(n))
        gone = 0
        while order:
            r = heapq.heappop(order)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[rank[places] == r]
            places = places[_every_second_linked(places, after)]
            if not len(places):
                continue
            right = after[places]
            symbol[places] = self.merged[r]
            rank[right] = none
            behind = after[right]
            after[places] = behind
            inner = behind < n
            before[behind[inner]] = places[inner]
            gone += len(places)
            left = before[places]
            enter(np.unique(np.concatenate((places, left[left >= 0]))))
        return n - gone


def _every_second(places: np.ndarray) -> np.ndarray:
    """Of pairs that overlap, as in a run of one symbol, every second one from the left."""
    return places[_every_second_linked(places, None)]


def _every_second_linked(places: np.ndarray, after: np.ndarray | None) -> np.ndarray:
    """Which of the sorted ``places`` to take so that none is the next one's left neighbour."""
    if not len(places):
        return np.zeros(0, bool)
    follows = places[:-1] + 1 if after is None else after[places[:-1]]
    run = np.concatenate(([True], places[1:] != follows))
    index = np.arange(len(places))
    return (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0


def pretoken_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens begin; ``offsets`` bound independent segments."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[data]
    lead = np.flatnonzero(data >= 0xC0)
    head = np.ones(n, bool)
    if len(lead):
        byte = data.astype(np.int64)
        size = 2 + (byte[lead] >= 0xE0) + (byte[lead] >= 0xF0)
        point = np.where(size == 2, byte[lead] & 0x1F, np.where(size == 3, byte[lead] & 0x0F, byte[lead] & 0x07))
        for k in (1, 2, 3):
            more = size > k
            point[more] = (point[more] << 6) | (byte[lead[more] + k] & 0x3F)
        of_point = classes[np.minimum(point, 0x10FFFF)]
        kind[lead] = of_point
        for k in (1, 2, 3):
            more = size > k
            kind[lead[more] + k] = of_point[more]
            head[lead[more] + k] = False
    segment_start = np.zeros(n + 1, bool)
    segment_start[offsets] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | segment_start[1:n]
    runs = np.flatnonzero(change)
    run_ends = np.append(runs[1:], n)
    is_space = kind[runs] == SPACE
    start = np.zeros(n + 1, bool)
    start[runs] = True
    # the last character of white space before other text goes apart, and a plain space joins that text
    followed = is_space & (run_ends < n) & ~segment_start[run_ends]
    last_head = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    start[last_head[run_ends[followed] - 1]] = True
    after = run_ends[followed]
    joined = after[data[after - 1] == 32]
    start[joined] = False
    # endings such as 's, where the apostrophe itself begins a pre-token
    quote = np.flatnonzero((data == 39) & start[:n])
    for ending in ENDINGS:
        e = len(ending)
        at = quote[quote + e < n]
        same = np.ones(len(at), bool)
        for k, c in enumerate(ending.encode(), 1):
            same &= (data[at + k] == c) & ~segment_start[at + k]
        at = at[same]
        start[at + 1] = False
        rest = at + 1 + e
        rest = rest[rest < n]
        start[rest[(kind[rest] == LETTER) & ~segment_start[rest]]] = True
    return np.flatnonzero(start[:n])


def _cut_specials(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment bounds with special strings as segments of their own, the row of each, and which are special."""
    found = []
    raw = data.tobytes()
    for content in specials:
        at = raw.find(content)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(content) <= offsets[row + 1]
            if inside:
                found.append((at, at + len(content)))
            at = raw.find(content, at + (len(content) if inside else 1))
    bounds = np.unique(np.concatenate((offsets, np.array(found, np.int64).reshape(-1))))
    special = np.isin(bounds[:-1], [a for a, _ in found])
    return bounds, np.searchsorted(offsets, bounds[:-1], "right") - 1, special


def _groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each group of equal spans, and each span's group. Spans of one hash are compared byte by byte."""
    _, at, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, own = ends - starts, at[back]
    other = sizes != sizes[own]
    same = np.flatnonzero(~other)
    places = np.repeat(np.cumsum(sizes[same]) - sizes[same], sizes[same])
    inner = np.arange(sizes[same].sum()) - places
    differs = data[np.repeat(starts[same], sizes[same]) + inner] != data[np.repeat(starts[own[same]], sizes[same]) + inner]
    other[same[np.repeat(np.arange(len(same)), sizes[same])[differs]]] = True
    alone = np.flatnonzero(other)
    back[alone] = len(at) + np.arange(len(alone))
    return np.concatenate((at, alone)), back


def count_batch(column: pa.Array, vocabulary: Vocabulary, classes: np.ndarray, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of a string column."""
    n_bytes, n_tokens = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for first, end, data, offsets in chunks(column):
        n_bytes[first:end] = np.diff(offsets)
        bounds, row, special = _cut_specials(data, offsets, vocabulary.special)
        starts = pretoken_starts(data, bounds, classes)
        counts = np.bincount(row[special], minlength=end - first)
        segment = np.searchsorted(bounds, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        plain = ~special[segment]
        starts, ends, segment = starts[plain], ends[plain], segment[plain]
        if len(starts):
            at, back = _groups(data, starts, ends)
            raw = data.tobytes()
            names = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            known = np.array([cache.get(name, -1) for name in names], np.int64)
            new = np.flatnonzero(known < 0)
            known[new] = vocabulary.count(data, starts[at[new]], ends[at[new]])
            small = [k for k in new.tolist() if len(names[k]) <= LONG]
            if len(cache) + len(small) > CACHE_ENTRIES:
                cache.clear()
            cache.update((names[k], int(known[k])) for k in small)
            counts = counts + np.bincount(row[segment], weights=known[back], minlength=end - first).astype(np.int64)
        n_tokens[first:end] = counts
    return n_bytes, n_tokens


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row; no shuffle.

    The vocabulary file and the table of character classes have fixed sizes (about
    1.5 and 1.1 MB) and are broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    classes = spark.sparkContext.broadcast(character_classes())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache = _vocabulary(content.value), {}
        for batch in batches:
            n_bytes, n_tokens = count_batch(batch.column(1), vocabulary, classes.value, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)
