"""Words of whole Arrow batches of texts as numpy arrays.

A batch is cut into blocks of at most ``BLOCK_BYTES`` of text (a longer text is a block of its own),
and the bytes of a block are read where Arrow keeps them. White space and ASCII classes are single
bytes in UTF-8, so words are found and hashed without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Word bytes of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that neighbouring inputs share no pattern."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is the empty text."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding at most ``limit`` bytes."""
    data, offsets = texts(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and n + 1 positions: where the words of each row begin."""
    word = np.zeros(len(data) + 1, dtype=bool)
    word[:-1] = inside[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = word[:-1]
    before[offsets[:-1]] = False  # a word never goes over the border of two rows
    starts = np.flatnonzero(word & ~before)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[1:]] = True
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word, eight bytes of every word at a time."""
    lengths = ends - starts
    out = lengths.astype(np.uint64)
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    rows, at, left = np.arange(len(starts)), starts, lengths
    while len(rows):
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        out[rows] = mix(out[rows] * np.uint64(0xD6E8FEB86659FD93) + part)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes, in order: len(words) - n + 1 of them."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + count]
    return mix(out)


def inner(bounds: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` n-grams over the joined words of several rows lie within one row."""
    ok = np.ones(max(count, 0), dtype=bool)
    for k in range(1, n):
        at = bounds[1:-1] - k
        ok[at[(at >= 0) & (at < count)]] = False
    return ok


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a flat array as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
