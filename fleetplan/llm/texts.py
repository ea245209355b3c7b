"""Whole columns of text as flat arrays of bytes and words.

Helpers for Arrow tasks: a batch is walked in blocks of whole rows, and inside a block words,
their hashes and hashes of word windows come from array operations, never from a loop over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of one Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS = 400
#: Bytes of text handled at a time; one longer row makes a block of its own.
BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: One random 64-bit value for each byte value.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def short_batches(spark) -> None:
    """Keep Arrow batches short in this session: rows can hold very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and the rows' offsets in it. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with about ``limit`` bytes."""
    data, offsets = utf8(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of ``values`` (64-bit each); equal spans, equal hashes."""
    n = len(values)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=sums[1:], dtype=np.uint64)
    found = (sums[ends] - sums[starts]) * inverse[starts]
    found += (ends - starts).astype(np.uint64) * _LENGTH
    return mix(found)


#: Longest span that a polynomial hash stands for. From 1,024 bytes on there are different spans whose polynomials are equal
#: for any odd base.
LONG_SPAN = 64


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes' values that do not overlap; long ones by BLAKE2."""
    found = span_hashes(values, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(values[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return found


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true places that do not cross a row's bounds."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_, close = np.ones(n, bool), np.ones(n, bool)
    np.logical_not(inside[:-1], out=open_[1:])
    np.logical_not(inside[1:], out=close[:-1])
    full = offsets[1:] > offsets[:-1]
    open_[offsets[:-1][full]] = True
    close[offsets[1:][full] - 1] = True
    return np.flatnonzero(inside & open_), np.flatnonzero(inside & close) + 1


#: Bytes of words between white space: everything but space and U+0009 to U+000D.
SPACED = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and all of the non-ASCII ones.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: The values of bytes with A-Z taken as a-z.
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the place of its first word (one more entry at the end)."""
    starts, ends = runs(kind[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def window_places(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of ``length`` words inside a row, and the number of windows of each row."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    total = int(counts.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift, counts
