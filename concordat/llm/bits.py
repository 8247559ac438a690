"""A one-probe Bloom filter of 64-bit hashes, of bounded size, made on executors and tested in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a filter that go in one row.
CHUNK = 1 << 12


def filter_bits(n: int, most: int, a_row: int = 16) -> int:
    """The size for n hashes, a power of two: a_row bits each, most at most."""
    return min(most, 1 << max(18, (a_row * n).bit_length()))


def chunk_rows(values: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """(chunk, counts) for the chunks of 64-bit values that are not all zero, compressed."""
    parts = [(k, zlib.compress(x.astype("<i8").tobytes(), 1)) for k, x in enumerate(values.reshape(-1, size)) if x.any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["chunk", "counts"])


def summed_chunks(found: DataFrame, total: int, size: int, join) -> np.ndarray:
    """total 64-bit values from rows (chunk, counts) of many tasks, joined by a ufunc on the executors; the driver gets
    total / size rows, whatever the number of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(zlib.decompress(x), "<i8")
                sums[k] = join(sums[k], value) if k in sums else value
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    out = np.zeros(total, np.int64)
    for row in found.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return out


def bit_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """bits / 64 words with the bit of each hash's low bits set. Each task fills a filter of its own; they are merged
    by chunks on the executors, and the driver gets bits / 64 words at most, whatever the number of rows."""
    size = min(CHUNK, bits // 64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.int64)
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy(zero_copy_only=False) & np.int64(bits - 1))
            np.bitwise_or.at(own, at >> 6, np.int64(1) << (at & 63))
        yield from chunk_rows(own, size)

    return summed_chunks(hashes.select(F.col(column)).mapInArrow(fill, "chunk int, counts binary"), bits // 64, size, np.bitwise_or)


def hits(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    at = hashes.view(np.int64) & np.int64(len(filled) * 64 - 1)
    return (filled[at >> 6] >> (at & 63) & 1).astype(bool)
