"""Words of whole texts, found with numpy over Arrow buffers inside a task.

A batch's texts stay one byte buffer.  Word starts and ends are found for all
texts at once, and each word gets a 64-bit hash that doesn't depend on where it
stands, so later steps work on integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that a step works on at once; a longer text goes alone.
SLICE_BYTES = 2 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: What stands between words of `[^\x20\x09-\x0D]+`.
SPACES = byte_class((0x20, 0x20), (0x09, 0x0D))
#: What stands between words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads all bits of x over all bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have, step = have + more, step * step
    return out[:n]


_cache: dict[str, np.ndarray] = {}
#: Bytes whose words are hashed at once, so that helping arrays don't grow with the text.
_STRETCH = 1 << 18


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 2 * _STRETCH:  # a single longer word: not kept
        return powers(_BASE, n), powers(_INVERSE, n)
    if "p" not in _cache:
        _cache["p"], _cache["q"] = powers(_BASE, 2 * _STRETCH), powers(_INVERSE, 2 * _STRETCH)
    return _cache["p"], _cache["q"]


@dataclass
class Words:
    """Words of some texts: data[starts[i]:ends[i]]; text d has words first[d] to first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def index_in_text(self) -> np.ndarray:
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out, i = np.empty(len(self), np.uint64), 0
        while i < len(self):
            base = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, base + _STRETCH, "right")))
            data, starts, ends = self.data[base : self.ends[j - 1]], self.starts[i:j] - base, self.ends[i:j] - base
            with np.errstate(over="ignore"):
                p, q = _power_tables(len(data) + 1)
                total = np.zeros(len(data) + 1, np.uint64)
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
                out[i:j] = mixed((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
            i = j
        return out

    def array(self) -> pa.Array:
        """The words as an Arrow binary array."""
        size = self.ends - self.starts
        offsets = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        mark = np.zeros(len(self.data) + 1, np.int8)
        mark[self.starts] = 1
        mark[self.ends] -= 1
        held = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[held]))])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def _alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters of scripts that don't part words begin and end: Thai, Lao, Myanmar, Khmer, kana, Han."""
    two = np.append(data[1:], 0)
    lead = ((data == 0xE0) & (two >= 0xB8) & (two <= 0xBB)) | ((data == 0xE1) & ((two <= 0x82) | (two == 0x9E) | (two == 0x9F)) & (two >= 0x80)) | (data == 0xE3) | ((data >= 0xE4) & (data <= 0xE9)) | ((data == 0xF0) & (two >= 0xA0))
    at = np.flatnonzero(lead)
    return at, np.minimum(at + np.where(data[at] == 0xF0, 4, 3), len(data))


def split(column: pa.Array, between: np.ndarray = SPACES, lower: bool = False, characters: bool = False) -> Words:
    """The words of each text: longest runs of bytes that aren't in `between`, after A-Z become a-z if `lower`.

    With `characters` each character of a script that doesn't part words is one.
    """
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(between[data], out=inside[1:-1])
    first_byte = np.zeros(len(data) + 1, bool)
    first_byte[offsets] = True
    if characters and len(data) and data.max() >= 0xE0:
        begin, end = _alone(data)
        first_byte[begin], first_byte[end] = True, True
    at = inside[1:-1]
    starts = np.flatnonzero(at & (~inside[:-2] | first_byte[:-1]))
    ends = np.flatnonzero(at & (~inside[2:] | first_byte[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column` (a longer text goes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d + 1]] along axis 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
