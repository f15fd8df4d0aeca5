"""Numpy helpers for columns of text inside Arrow tasks: byte views, rolling sums, words, shingles, hash tables."""

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# An odd multiplier of 64 bits, its inverse modulo 2**64, and the constants of a common bit mixer.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
# The white space of the word contract.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

PIECE_BYTES = 1 << 19


def worker_memo(name: str, make: Callable):
    """A value kept by a Python worker over its tasks. Package code is shipped by value, so module globals are not."""
    store = sys.modules.setdefault("_tidegauge_worker", types.ModuleType("_tidegauge_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def handed_back(f: Callable) -> Callable:
    """A function of batches after whose last one the worker, which goes on to other tasks, returns the memory it has freed."""
    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose results look random."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of every piece of a column."""
    data, offsets = buffer_of(column)
    for a, b in pieces(offsets, limit):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    def make():
        return {}
    store = worker_memo("powers", make)
    have = store.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:  # longer ones serve a single very long text
            store[base] = have
    return have[:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = sum of (data[k] + 1) * BASE**k for i <= k < j."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal spans of bytes give equal hashes, wherever they stand."""
    inverse = powers(len(sums), BASE_INVERSE)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not outside; rows break runs."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(outside, out=inside[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inside[1:-1] & (~inside[:-2] | first[:-1])
    finish = inside[1:-1] & (~inside[2:] | first[1:])
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and hash of every word `[^\\x20\\x09-\\x0D]+`, A-Z lowered."""
    data = LOWER[data]
    start, end = spans(data, offsets, IS_SPACE[data])
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, span_hashes(rolling(data), start, end)


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values, as one array shorter by n - 1."""
    out = np.zeros(max(0, len(values) - n + 1), np.uint64)
    for j in range(n):
        out += values[j:j + len(out)] * np.uint64(pow(BASE, j + 1, 1 << 64))
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its n-word shingles; fewer words give one shingle, none give none."""
    rows = len(offsets) - 1
    row, _, _, hashes = words(data, offsets)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    joined = windows(hashes, n)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            yield np.unique(joined[a:b - n + 1])
        elif b > a:
            yield windows(hashes[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def packed(values: np.ndarray) -> bytes:
    """An array as compressed bytes; counters are mostly zeros."""
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)


def binary(items) -> pa.Array:
    return pa.array(items, pa.binary())


class Memo(dict):
    """Results of a function by key, at most `limit` of them; then it starts anew."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
