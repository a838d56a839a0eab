"""Texts of an Arrow batch as flat byte arrays, and vectorised words and hashes on them.

Prefix sums of a polynomial over bytes give every substring's hash, the same on
every machine.  Spans (words, lines) are hashed modulo the prime 2**31 - 1 with
two bases.  Hashes modulo 2**64, which are equal for some different strings
(Thue-Morse words) whatever the base, serve n-grams of bounded length only.
Where equality decides a result exactly, bytes or digests() settle it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_PRIME = _U((1 << 31) - 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + (64 << 10))
            self.up, self.down = (_powers(b, size) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Slice(NamedTuple):
    """Rows first..last of a batch: their bytes, and where each row begins (one more entry than rows)."""

    first: int
    last: int
    data: np.ndarray
    offs: np.ndarray


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, buffers = len(column), column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows of at most limit bytes, or one longer row."""
    data, offs = flat(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield Slice(first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


def prefix(data: np.ndarray) -> np.ndarray:
    """prefix()[j] - prefix()[i], times the inverse power i, is the hash of data[i:j]."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=out[1:])
    return out


class PrimePowers:
    """Powers of two bases and of their inverses modulo the prime, grown on demand."""

    bases = (0x2545F491, 0x5851F42D)

    def __init__(self) -> None:
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def to(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.tables or len(self.tables[0][0]) < n:
            size = max(n, SLICE_BYTES + (64 << 10))
            self.tables = [(_prime_powers(b, size), _prime_powers(pow(b, -1, int(_PRIME)), size)) for b in self.bases]
        return self.tables


def _prime_powers(base: int, n: int) -> np.ndarray:
    out, filled, step = np.ones(n, _U), 1, base
    while filled < n:
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * _U(step) % _PRIME
        filled, step = filled + m, step * step % int(_PRIME)
    return out


PRIME_POWERS = PrimePowers()


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or the prime itself for 0, for any 64-bit x."""
    x = (x & _PRIME) + (x >> _U(31))
    return (x & _PRIME) + (x >> _U(31))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[s:e] for each start and end."""
    out = np.zeros(len(start), _U)
    for up, down in PRIME_POWERS.to(len(data) + 1):
        terms = (data.astype(_U) + _U(1)) * up[: len(data)]
        if len(data) > 1 << 24:  # where sums of 40-bit terms might pass 64 bits
            terms = _folded(terms)
        pre = np.zeros(len(data) + 1, _U)
        np.cumsum(terms, out=pre[1:])
        h = _folded(_folded(_folded(pre[end] - pre[start]) % _PRIME * down[start])) % _PRIME
        out = (out << _U(31)) + h
    return mix(out)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit cryptographic digests of data[s:e], as two columns of int64."""
    view = memoryview(np.ascontiguousarray(data))
    made = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[x:x+size] equals data[y:y+size] for every entry."""
    step = 1 << 16  # entries laid out at once
    for i in range(0, len(x), step):
        n = size[i : i + step]
        run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(x[i : i + step], n) + run] != data[np.repeat(y[i : i + step], n) + run]).any():
            return False
    return True


class Words(NamedTuple):
    """Maximal runs of other than ASCII white space: start, end (bytes), hash; of[r]:of[r+1] are those of row r."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def words(part: Slice, data: np.ndarray | None = None) -> Words:
    data = part.data if data is None else data
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[part.offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[: n - 1] if n else False
    start = np.flatnonzero(inside[:n] & (~before | edge[:n]))
    end = np.flatnonzero(inside[:n] & (~inside[1:] | edge[1:])) + 1
    return Words(start, end, spans_hash(data, start, end), np.searchsorted(start, part.offs))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words within a row, and the index of each one's first word."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(n, _U)
    for j in range(size):
        out += w.hash[j : j + n] * _U(pow(_BASE, 3 + 2 * j, 1 << 64))
    row = w.row()
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return mix(out[at]), at


def code_points(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (data & 0xC0) != 0x80
