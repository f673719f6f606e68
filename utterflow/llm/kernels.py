"""Array kernels shared by the corpus operators: word spans, word hashes, shingles.

Everything here works on one bounded chunk of rows inside a Spark task. A chunk
holds about ``CHUNK_BYTES`` of text, or one single text if that is longer, so a
task's memory follows its longest text and never its partition.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. UTF-8 never uses
these bytes inside a longer character, so byte runs equal character runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Places of a span whose terms come from a table.
_TABLED = 64

IS_WORD_BYTE = np.ones(256, bool)
IS_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = IS_WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word, in order."""
    inside = word_byte[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    edges = edges[edges > 0] - 1
    after[edges] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _terms(keys: np.ndarray) -> np.ndarray:
    """A random-looking number for each (place in the span, byte)."""
    return mix(mix(keys.astype(_U64) * _U64(_BASE) + _U64(1)) + _U64(_BASE))


_TERMS = _terms(np.arange(_TABLED << 8))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Each byte gives a number that depends on the byte and its place in the span and is not
    linear in either, and the sum of a span's numbers is mixed with its length.
    """
    sizes = (ends - starts).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    keys = (place << 8) | data[place + np.repeat(starts, sizes)]
    terms = _TERMS[np.minimum(keys, len(_TERMS) - 1)]
    far = np.flatnonzero(keys >= len(_TERMS))
    terms[far] = _terms(keys[far])
    total = np.concatenate((np.zeros(1, _U64), np.cumsum(terms, dtype=_U64)))
    return mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(_U64))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values; len(values) - width + 1 of them."""
    n = max(0, len(values) - width + 1)
    total = np.zeros(n, _U64)
    for k in range(width):
        total = total * _U64(0xD6E8FEB86659FD93) + values[k : k + n]
    return mix(total + _U64(width))


def word_table(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the first word of each row (rows + 1 values), and the spans."""
    starts, ends, row = word_spans(data, offsets)
    hashes = span_hashes(ASCII_LOWER[data] if lower else data, starts, ends)
    return hashes, np.searchsorted(row, np.arange(len(offsets))), starts, ends


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as sorted hashes, back to back, and their bounds.

    A row with fewer words than ``width`` has its whole sequence as one shingle, a
    row without words has none.
    """
    windows = window_hashes(hashes, width)
    parts, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            one = np.sort(windows[a : b - width + 1])
            if len(one) > 1:
                one = one[np.concatenate(([True], one[1:] != one[:-1]))]
        elif b > a:
            one = window_hashes(hashes[a:b], b - a)
        else:
            one = hashes[:0]
        parts.append(one)
        sizes.append(len(one))
    flat = np.concatenate(parts) if parts else np.empty(0, _U64)
    return flat, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64)


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m, uint64) of the sets between ``bounds``.

    Each element draws, step by step, one place of its own random permutation of the
    m places and a fraction; place p keeps the least step + fraction. As every
    element visits each place at another step, places are negatively correlated,
    which lowers the estimate's variance. A set stops as soon as all its places
    hold less than the next step, since no later step can lower them: about
    m ln m / n steps for n elements. Empty sets keep the greatest value everywhere.
    """
    rows = len(bounds) - 1
    out = np.full((rows, m), np.iinfo(_U64).max, _U64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    order: np.ndarray | None = None
    for step in range(m):
        if not len(row):
            break
        draw = mix(elements + _U64((step + 1) * _BASE & (1 << 64) - 1))
        pick = (step + (((draw >> _U64(32)) * _U64(m - step)) >> _U64(32)).astype(np.int64)).astype(np.int64)
        value = (_U64(step) << _U64(32)) | (draw & _U64(0xFFFFFFFF))
        if order is None:
            place = pick
        else:
            at = np.arange(len(row))
            place = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, step]
        np.minimum.at(flat, row * m + place, value)
        rows_left = np.unique(row)
        going = np.zeros(rows, bool)
        going[rows_left] = out[rows_left].max(axis=1) >= (_U64(step + 1) << _U64(32))
        keep = going[row]
        if order is None:
            row, elements, pick = row[keep], elements[keep], pick[keep]
            order = np.tile(np.arange(m, dtype=np.uint16), (len(row), 1))
            order[np.arange(len(row)), pick] = 0
        elif not keep.all():
            row, elements, order = row[keep], elements[keep], order[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each signature, the band's number mixed in."""
    n = len(signatures)
    keys = np.zeros((n, bands), _U64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = keys * _U64(0x9FB21C651E98DF25) + mix(signatures[:, k : bands * rows : rows])
        return mix(keys + np.arange(1, bands + 1, dtype=_U64) * _U64(_BASE))


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of values between bounds as an Arrow list<int64>."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == _U64 else values))
