"""Texts of an Arrow batch as one run of UTF-8 bytes, and hashes over it, all in NumPy.

Every function here works on a bounded slice of a batch (a few MB, or one text if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_SEQ = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> _S30)
    x *= _MIX_A
    x ^= x >> _S27
    x *= _MIX_B
    x ^= x >> _S31
    return x


class Powers:
    """Powers of a hash base and of its inverse, grown as needed, with the values of bytes."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.table = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.folded = self.table.copy()
        self.folded[65:91] = self.table[97:123]

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, x, dtype=np.uint64))]) for x in (self.base, self.inverse))


#: Two independent hashes of 64 bits, for uses where equal hashes stand for equal bytes of many strings.
FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def prefix_hash(data: np.ndarray, fold: bool = False, powers: Powers = FIRST) -> np.ndarray:
    """Prefix sums of a polynomial over randomised byte values, modulo 2**64; length ``len(data) + 1``."""
    powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((powers.folded if fold else powers.table)[data] * powers.up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = FIRST) -> np.ndarray:
    """Hash of each ``data[start:end]``: equal bytes give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers.down[start] + (end - start).astype(np.uint64))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) for runs of rows of at most ``limit`` bytes, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans_of(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True in ``inside``, never across a position in ``cuts``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < n)]
    start[at] |= inside[at]
    end[at - 1] |= inside[at - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run of bytes that are not ASCII white space), and the words of each row as offsets."""
    start, end = spans_of(~SPACE[data], offsets)
    return start, end, np.searchsorted(start, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words, A-Z as a-z, and the offsets of each row's own.

    A row of fewer words has its whole sequence as one; a row without words has none.
    """
    start, end, first = words(data, offsets)
    word = span_hash(prefix_hash(data, fold=True), start, end)
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(at[-1], dtype=np.uint64)
    long = count >= size
    place = np.arange(at[-1]) - np.repeat(at[:-1], made) + np.repeat(first[:-1], made)
    whole = np.repeat(long, made)
    p = place[whole]
    acc = np.zeros(len(p), dtype=np.uint64)
    for k in range(size):
        acc += word[p + k] * _SEQ[k]
    out[whole] = mix(acc + np.uint64(size))
    for row in np.flatnonzero(~long & (count > 0)):
        own = word[first[row] : first[row + 1]]
        out[at[row]] = mix((own * _SEQ[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    return out, at
