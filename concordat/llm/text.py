"""Arrow text columns as numpy arrays: words, their 64-bit hashes and shingles, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same map for bytes.translate.
LOWER_BYTES = LOWER.tobytes()
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: An odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 19

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(20, int(n).bit_length() + 1)
        _powers[:] = []
        for base in (BASE, INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts, of about limit bytes each."""
    raw, off = buffers(column)
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, last, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


@dataclass
class Words:
    """The words of some texts. start, end: byte positions in data; first: index of each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(raw: np.ndarray, off: np.ndarray) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of texts lower-cased in A-Z only, with 64-bit hashes that depend on nothing else."""
    data = LOWER[raw]
    n = len(data)
    solid = np.zeros(n + 2, dtype=bool)
    solid[1 : n + 1] = ~SPACE[raw]
    edge = solid[1:] & ~solid[:-1]  # at i: a word begins
    stop = ~solid[1:] & solid[:-1]  # at i: a word ended before i
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[solid[cuts] & solid[cuts + 1]]  # a word of one text touches a word of the next
    edge[cuts] = True
    stop[cuts] = True
    start, end = np.flatnonzero(edge), np.flatnonzero(stop)
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    value = mix(value + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return Words(data, start, end, value, np.searchsorted(start, off))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's k-word shingles in order; a text of fewer words, but not none, has one."""
    n = w.counts()
    each = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(each, out=off[1:])
    at = np.repeat(w.first[:-1] - off[:-1], each) + np.arange(off[-1])
    length = np.repeat(np.minimum(n, k), each)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    value = length.astype(np.uint64)
    for j in range(k):
        value = value * np.uint64(0x2545F4914F6CDD1D) + np.where(j < length, padded[at + j], np.uint64(0))
    return mix(value), off
