"""Exact duplicates by two passes over a Bloom filter.

Pass 1 sets filter bits from the digest of each text and keeps the bits that two rows or more have set. Pass 2 tests
each row's bits against those: a row of which some bit was set once only has no equal and passes straight through,
without a shuffle. The others, few unless most of the corpus is copies, meet by digest and are settled exactly. The
filter has a fixed largest size; beyond the number of rows that this serves well, more rows take the exact way and the
result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.stage import materialise, salted_left_join, small_batches, with_plain_names
from concordat.llm.text import LOWER_BYTES, buffers

PROBES = 2


def _digests(column: pa.Array, fold: bool) -> list[bytes]:
    raw, off = buffers(column)
    data = raw.tobytes()
    if fold:
        data = data.translate(LOWER_BYTES)
    return [hashlib.sha256(data[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Rows of PROBES bit positions; bits is a power of two."""
    if not digests:
        return np.zeros((0, PROBES), np.int64)
    parts = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)[:, :PROBES]
    return (parts & np.uint64(bits - 1)).astype(np.int64)


def repeated_bits(docs: DataFrame, text: str, bits: int, fold: bool) -> np.ndarray:
    """Pass 1: the filter of positions set at least twice, bits / 8 bytes.

    Each position is counted with map-side sums; what reaches the driver is the filter itself, in 64-bit words, at
    most bits / 64 of them whatever the number of rows.
    """

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(_digests(batch.column(0), fold), bits).ravel()
            at, times = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times)], ["at", "times"])

    words = (
        docs.select(text)
        .mapInArrow(positions, "at long, times long")
        .groupBy("at")
        .agg(F.sum("times").alias("times"))
        .filter("times >= 2")
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True, max_bits: int = 1 << 26, salts: int = 32) -> DataFrame:
    """docs with four more columns: _digest (SHA-256 of the text, with fold of the
    text lower-cased in A-Z only), _keep_id, _group_size, _kept.

    Of rows with equal texts the one with the largest id is kept. A null text counts as empty; a null id is smaller
    than any other. Of rows equal in text and id exactly one is kept. Columns of other names pass unchanged; a column
    that has one of the four names is replaced. An empty table gives an empty table. The filter has 16 bits a row, in
    a power of two between 2**16 and max_bits.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("_digest", "_keep_id", "_group_size", "_kept")
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    found = _marked_copies(docs.toDF(*at.values()), at[id_col], at[text_col], fold, max_bits, salts)
    return found.toDF(*names, "_digest", "_keep_id", "_group_size", "_kept")


def _marked_copies(docs: DataFrame, id_col: str, text_col: str, fold: bool, max_bits: int, salts: int) -> DataFrame:
    """exact_duplicates of a table whose column names clash with nothing."""
    n = docs.count()
    bits = min(max_bits, 1 << max(16, (16 * n).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs, text_col, bits, fold))
    at = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields + [T.StructField("_row", T.LongType()), T.StructField("_digest", T.BinaryType()), T.StructField("_maybe", T.BooleanType())])
    names = schema.fieldNames()

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            digests = _digests(batch.column(at), fold)
            where = _positions(digests, bits)
            hit = ((filled[where >> 6] >> (where & 63)) & 1).all(axis=1) if len(where) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(hit)], names)

    flagged = docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(flag, schema)
    alone = flagged.filter("not _maybe").select(
        *docs.columns, "_digest", F.col(id_col).alias("_keep_id"), F.lit(1).cast("long").alias("_group_size"), F.lit(True).alias("_kept")
    )
    maybe = materialise(flagged.filter("_maybe"), "maybe-repeated")
    groups = (
        maybe.groupBy("_digest")
        .agg(F.max(F.struct(F.col(id_col).alias("id"), F.col("_row").alias("row"))).alias("_keep"), F.count(F.lit(1)).alias("_group_size"))
        .filter("_group_size > 1")
    )
    met = salted_left_join(maybe, groups, "_digest", "_row", salts).select(
        *docs.columns,
        "_digest",
        F.when(F.col("_keep").isNull(), F.col(id_col)).otherwise(F.col("_keep.id")).alias("_keep_id"),
        F.coalesce("_group_size", F.lit(1).cast("long")).alias("_group_size"),
        (F.col("_keep").isNull() | (F.col("_keep.row") == F.col("_row"))).alias("_kept"),
    )
    return alone.unionByName(met)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with docs' own columns, whatever their names."""
    return with_plain_names(docs, lambda d, at: exact_duplicates(d, at[id_col], at[text_col]).filter("_kept"))
