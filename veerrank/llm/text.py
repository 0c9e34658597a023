"""Words of whole Arrow batches as flat arrays, for the operators that work on text inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Stands for a null id inside tasks; turned back into null in every result.
NULL_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; both hold byte by byte in UTF-8.
SPACED = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; null becomes NULL_ID."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_column(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        total, at = 0, 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(at, row - at)
                total, at = 0, row
            total += int(size)
        yield batch.slice(at)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the row bounds in them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def split(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words of all rows in order, and the bounds of each row's words among them."""
    data = LOWER[data] if lower else data
    keep = kind[data]
    before = np.zeros(len(keep), bool)
    before[1:] = keep[:-1]
    before[bounds[:-1][bounds[:-1] < len(keep)]] = False
    starts = np.flatnonzero(keep & ~before)
    row_bounds = np.searchsorted(starts, bounds)
    gone = np.concatenate([[0], np.cumsum(~keep, dtype=np.int64)]) if len(starts) else np.zeros(1, np.int64)
    offsets = np.append(starts - gone[starts], np.count_nonzero(keep)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
    return words, row_bounds


def codes(words: pa.BinaryArray) -> tuple[np.ndarray, list[bytes]]:
    """Each word as an index into the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct), np.uint64, len(distinct))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes of all runs of words in a flat array, by an invertible polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.full(n + 1, _BASE, np.uint64)
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        power[0] = inverse[0] = 1
        self.power = np.cumprod(power)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(inverse)[:n])])

    def runs(self, length: int) -> np.ndarray:
        """The hash of each run of `length` words, by its start; mixed so that order and low bits are even."""
        n = len(self.sums) - 1
        if n < length:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[: n - length + 1]) * self.power[length - 1 : n])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def starts_within(row_bounds: np.ndarray, length: int) -> np.ndarray:
    """For each word whether a run of `length` words that starts at it ends in the same row."""
    n = int(row_bounds[-1])
    end = np.repeat(row_bounds[1:], np.diff(row_bounds))
    return np.arange(n) + length <= end


def covered(flags: np.ndarray, length: int) -> np.ndarray:
    """Words that lie in a run of `length` words whose start is flagged."""
    change = np.zeros(len(flags) + length + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change)[: len(flags)] > 0


def row_sums(flags: np.ndarray, row_bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[row_bounds])
