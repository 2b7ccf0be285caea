"""Texts of an Arrow batch as flat numpy arrays: bytes, words and fingerprints of ranges.

Everything here works on one batch of whole documents inside a task. A null text counts as empty. Memory is a
fixed multiple of the slice size, or of the longest single document where that is larger."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE_BYTES = 512 << 10

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its values begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Give memory that is free back to the system. A Python worker outlives its task, and the executor's other
    processes need the room; the C library keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row. Free memory goes back at the end."""
    try:
        yield from _sliced(batches, column, limit)
    finally:
        release()


def _sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, before + limit, "right")) - at)
            yield batch.slice(at, n)
            at += n


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the document that it stands in. Words never cross documents."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_document(doc: np.ndarray, n: int) -> np.ndarray:
    """The n + 1 places in a list sorted by document where each document's entries begin and end."""
    return np.searchsorted(doc, np.arange(n + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Fingerprints are computed modulo this prime.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30, _LOW29, _LOW32 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1)
_29, _30, _31, _32, _61 = (np.uint64(n) for n in (29, 30, 31, 32, 61))


#: Values worked on at once, so that what lies between stays in a core's cache.
_AT_ONCE = 1 << 14


def _folded(x: np.ndarray) -> np.ndarray:
    """Values modulo the prime up to one more fold (below 2**61 + 8), in place."""
    high = x >> _61
    x &= _P
    x += high
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values modulo the prime, in place."""
    _folded(x)
    x -= (x >= _P) * _P
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Folded products: halves of 31 bits, 2**61 being one."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 += a1
    a1 += a0 * b0
    a1 += middle >> _30
    middle &= _LOW30
    middle <<= _31
    a1 += middle
    return _folded(a1)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below it."""
    return _reduced(_times(a, b))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.array([pow(base, len(out), PRIME)], np.uint64))])
    return out[:n]


def _sums(values: np.ndarray, powers: np.ndarray, small: bool) -> np.ndarray:
    """Running sums of the products modulo the prime, from zero on. ``small`` values, below 512, are summed before
    their products are reduced; others are reduced and summed by halves, so that nothing overflows."""
    out = np.zeros(len(values) + 1, np.uint64)
    last = np.uint64(0)
    for at in range(0, len(values), _AT_ONCE):
        part = values[at : at + _AT_ONCE]
        by = powers[at : at + len(part)]
        if small:
            high, low, bits, shift = by >> _31, by & _LOW31, _LOW30, _31
            high *= part
            low *= part
            high = np.cumsum(high, out=high)
            low = np.cumsum(low, out=low)
            low += high >> _30
        else:
            product = _times(part, by)
            high = np.cumsum(product >> _32)
            product &= _LOW32
            low, bits, shift = np.cumsum(product, out=product), _LOW29, _32
            low += high >> _29
        high &= bits
        high <<= shift
        low += high
        low += last
        out[at + 1 : at + 1 + len(low)] = _folded(low)
        last = out[at + len(low)]
    return out


class Rolling:
    """Fingerprints of any range of a sequence from one running sum: a polynomial modulo 2**61 - 1 in a base drawn from
    all residues. Two different sequences of n symbols agree for at most n of the bases, whatever their structure."""

    _made: dict[int, tuple] = {}

    def __init__(self, seed: int):
        self.seed = seed
        if seed in self._made:
            self.base, self.inverse, self.table, self.up, self.down = self._made[seed]
            return
        drawn = hashlib.blake2b(b"rolling fingerprint %d" % seed, digest_size=16).digest()
        self.base = int.from_bytes(drawn, "little") % (PRIME - 2) + 2
        self.inverse = pow(self.base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)
        self.table = np.arange(256, dtype=np.uint64) + np.uint64(1)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        self._made[self.seed] = (self.base, self.inverse, self.table, self.up, self.down)

    def load(self, symbols: np.ndarray) -> Rolling:
        """Take a sequence of bytes or of 64-bit values."""
        small = symbols.dtype == np.uint8
        values = self.table[symbols] if small else _folded(mix(symbols.astype(np.uint64)))
        self._reach(len(values) + 1)
        self.sums = _sums(values, self.up, small)
        return self

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint of each range, of its symbols and their number."""
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), _AT_ONCE):
            a, z = starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE]
            part = self.sums[z]
            part += _P + _P
            part -= self.sums[a]
            part = _reduced(_times(_folded(part), self.down[a]))
            part += (z - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out[at : at + _AT_ONCE] = mix(part)
        return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
