"""Words of whole texts as NumPy arrays, straight from Arrow's buffers.

A word is a run of characters outside space and \\t \\n \\v \\f \\r. These are single bytes in
UTF-8 and no other character holds them, so words are found and hashed on bytes; no Python
string is made. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HASH_BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


@dataclass
class Words:
    """Words of consecutive documents: hash and byte range of each; ``ptr`` bounds each document's words."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(kind: str, base: np.uint64, size: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < size:
        table = np.full(max(size, 1 << 16), base, np.uint64)
        table[0] = 1
        table = _powers[kind] = np.cumprod(table, dtype=np.uint64)
    return table[:size]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each text's offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range; ranges are in order and don't overlap. An empty range hashes to one value."""
    hashes = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        till = max(done + 1, int(np.searchsorted(end, start[done] + HASH_BLOCK, "right")))
        low, high = start[done], end[till - 1]
        part = data[low:high]
        value = _VALUE[_LOWER[part] if lower else part] * _power_table("up", _ODD, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        first, last = start[done:till] - low, end[done:till] - low
        hashes[done:till] = mix((total[last] - total[first]) * _power_table("down", _INVERSE, len(part) + 1)[first])
        done = till
    return hashes


def bytes_outside(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie outside these ranges of ASCII (ends included)."""
    outside = np.ones(256, bool)
    for low, high in ranges:
        outside[low : high + 1] = False
    return outside


def bounds(column: pa.Array, solid_bytes: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last byte of each run of ``solid_bytes``, where each text's runs begin, the bytes and the texts' offsets."""
    data, offsets = text_buffers(column)
    solid = solid_bytes[data]
    after, before = np.zeros(len(data), bool), np.zeros(len(data), bool)
    after[1:], before[:-1] = solid[:-1], solid[1:]
    after[offsets[:-1][offsets[:-1] < len(data)]] = False
    before[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~after), np.flatnonzero(solid & ~before) + 1
    return start, end, np.searchsorted(start, offsets), data, offsets


def find_words(column: pa.Array, lower: bool = False, solid: np.ndarray | None = None) -> Words:
    """Words of each text; ``lower`` folds A-Z in the hashes; ``solid`` are the bytes of words, if others than non-space."""
    start, end, ptr, data, offsets = bounds(column, ~_SPACE if solid is None else solid)
    return Words(hash_ranges(data, start, end, lower), start, end, ptr, data, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z folded."""
    return _LOWER[data]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold at most ``max_bytes``; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))).astype(np.int64)
    row, base = 0, 0
    while row < batch.num_rows:
        till = max(row + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(row, till - row)
        row, base = till, int(ends[till - 1])


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given lengths."""
    lengths = np.asarray(lengths, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    if not len(lengths):
        return np.zeros(0, np.int64)
    step = np.ones(int(lengths.sum()), np.int64)
    step[0] = starts[0]
    step[np.cumsum(lengths)[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
