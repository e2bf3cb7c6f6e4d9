"""Vectorised word spans and 64-bit hashes over the UTF-8 bytes of Arrow text columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  Separators are ASCII, so working on bytes gives the
same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19  # texts are hashed in blocks that stay in the processor's cache
LONG_WORD = 24  # polynomials modulo 2**64 have collisions for every base, but none of so small a degree
_MASK = (1 << 64) - 1
_BASE = 0xD6E8FEB86659FD93  # odd, hence invertible modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

ARE_WORD = np.ones(256, dtype=bool)
ARE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words without ASCII punctuation.
ARE_PLAIN = ARE_WORD.copy()
ARE_PLAIN[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(table: np.ndarray, base: int, n: int) -> np.ndarray:
    if len(table) >= n:
        return table
    out = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for ``i < n`` (kept between calls)."""
    global _powers, _inverses
    _powers = _grown(_powers, _BASE, n)
    _inverses = _grown(_inverses, _BASE_INVERSE, n)
    return _powers[:n], _inverses[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def ragged_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the given spans, one after the other."""
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return at, data[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums that give the hash of any byte range, see :func:`range_hash`."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]``, a function of these bytes alone."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span's bytes: a digest beyond ``LONG_WORD`` bytes, a polynomial up to there."""
    out = range_hash(prefix_sums(data), starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        digests = [blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        out[long] = np.frombuffer(b"".join(digests), "<u8")
    return out


def text_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(stop, n)
        row = min(stop, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, are_word: np.ndarray = ARE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (with the total at the end)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = are_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool, are_word: np.ndarray = ARE_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the first word of each row."""
    starts, ends, bounds = word_spans(data, offsets, are_word)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), starts, ends, bounds


def sequence_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values (runs over row borders included)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x100000001B3 | 1)
        out += words[k : len(words) - n + 1 + k]
        if k % 4 == 3:
            out = mix(out)
    return mix(out + np.uint64(n))


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of each row; shorter rows give their whole sequence, empty rows none."""
    runs = sequence_hash(words, n)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield sequence_hash(words[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def ragged(values: np.ndarray, counts: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    """Arrow lists of the given lengths over one flat array."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type_))


def over_batches(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cache-sized slices of the input with their text bytes and offsets."""
    for batch in batches:
        data, offsets = text_block(batch.column(column))
        for a, b in blocks(data, offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
