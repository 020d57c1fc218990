"""Vectorised text primitives shared by the corpus operators.

A batch of texts arrives as an Arrow binary array.  All words of the batch are
found and hashed with a handful of numpy passes over its bytes, so no Python
loop runs per word.  Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes with
A-Z lower-cased; non-ASCII letters keep their case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


BASE_INV = U64(_inverse(int(BASE)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_UPPER = np.arange(65, 91)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[_UPPER] = _CODE[_UPPER + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW = _powers(BASE, 1 << 16)
_POW_INV = _powers(BASE_INV, 1 << 16)


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    global _POW, _POW_INV
    if n > len(_POW):
        _POW, _POW_INV = _powers(BASE, 2 * n), _powers(BASE_INV, 2 * n)
    return (_POW if base == BASE else _POW_INV)[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a (large) binary array and the n+1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of consecutive texts: hash, byte range and text of each.

    hashes[starts[i]:starts[i+1]] are those of text i, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        if n:
            edge[1:n] = solid[1:] != solid[:-1]
            edge[0], edge[n] = solid[0], solid[-1]
            inner = offsets[1:-1]
            inner = np.unique(inner[(inner > 0) & (inner < n)])
            glued = inner[solid[inner - 1] & solid[inner]]  # words that touch across two texts
            at = np.flatnonzero(edge)
            if len(glued):
                at = np.sort(np.concatenate([at, glued, glued]), kind="stable")
        else:
            at = np.zeros(0, dtype=np.int64)
        self.begin, self.end = at[0::2], at[1::2]
        code = (_CODE_LOWER if lower else _CODE)[data]
        # Positions restart at each block of 65536 bytes' multiple only through the power table, so sums stay exact modulo 2**64.
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(code * powers_of(BASE, n), out=total[1:])
        h = (total[self.end] - total[self.begin]) * powers_of(BASE_INV, n + 1)[self.begin]
        self.hashes = mix(h + (self.end - self.begin).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        self.starts = np.searchsorted(self.begin, offsets, side="left")
        self.starts[-1] = len(self.begin)

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def spans_of(starts: np.ndarray) -> np.ndarray:
    """For each element of consecutive groups, the group's number."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def slices(column: pa.Array, budget: int = 8 << 20):
    """Consecutive parts (start, part) of a binary column with about `budget` bytes each, one value at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + budget, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, column.slice(at, to - at)
        at = to


def crc32_mod(ids, modulus: int) -> np.ndarray:
    """crc32(str(id)) mod modulus for each id; -1 for null."""
    import zlib

    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids], dtype=np.int64)
