"""Hard negatives by product quantisation with residual bounds.

Each vector of integers is cut into short parts, and each part is replaced by the nearest of 256 centres, so that a
vector is a row of bytes and the norm of what the centres leave over. A table of an anchor's inner products with all
centres gives a row's score by lookups; by Cauchy and Schwarz the true score lies within the product of the anchor's
norm and the row's residual norm. Rows that this interval cannot exclude are scored again in whole numbers, so that
results are exact whatever the centres are. Anchors meet rows block by block, and neither side has to fit anywhere
whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.stage import discard, materialise

#: The centres are fitted on at most so many rows, those whose ids have the least hashes; every row is encoded.
SAMPLE = 4096
#: Components of a part, and centres of it.
PART, CENTRES = 2, 256
#: Rows of a block, and anchors of one.
ROWS, ANCHORS = 4096, 512
#: Bytes of lookup tables that a task keeps for a block of anchors.
KEPT = 1 << 26
#: Stands for a null id, which ranks last.
NO_ID = (1 << 63) - 1
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Beyond any rounding of the bounds, relative to the norms.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """row, id, label, vector (array of long) of the rows that take part, written once; row tells rows apart."""
    x = F.col(vector_col).cast("array<double>")
    known = F.col(label_col).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)), F.lit(False))
    return materialise(
        rows.filter(known).select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
            F.col(label_col).cast("long").alias("label"),
            F.transform(x, lambda v: F.floor(v * scale)).alias("vector"),
            F.col("_anchor").alias("anchor"),
        ),
        "whole-vectors",
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of 64-bit integers; shorter ones end in zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def parts(x: np.ndarray) -> np.ndarray:
    """(parts, rows, PART) of vectors, as doubles."""
    short = -x.shape[1] % PART
    wide = np.pad(x.astype(np.float64), ((0, 0), (0, short))) if short else x.astype(np.float64)
    return np.ascontiguousarray(wide.reshape(len(x), wide.shape[1] // PART, PART).transpose(1, 0, 2))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row of one part."""
    return (0.5 * (centres * centres).sum(axis=1) - x @ centres.T).argmin(axis=1)


def fit_centres(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """(parts, CENTRES, PART) by Lloyd's rounds from rows drawn with a fixed seed."""
    rng, out = np.random.default_rng(7), []
    for part in parts(x):
        centres = part[rng.choice(len(part), CENTRES, replace=len(part) < CENTRES)] if len(part) else np.zeros((CENTRES, PART))
        for _ in range(rounds if len(part) else 0):
            at = nearest(part, centres)
            n = np.bincount(at, minlength=CENTRES)
            sums = np.stack([np.bincount(at, part[:, j], CENTRES) for j in range(PART)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        out.append(centres)
    return np.array(out).reshape(-1, CENTRES, PART)


def encode(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, a row of bytes a part; residual norms) of vectors."""
    codes, left = np.zeros((len(centres), len(x)), np.uint8), np.zeros(len(x))
    for m, part in enumerate(parts(x)):
        codes[m] = nearest(part, centres[m])
        left += ((part - centres[m][codes[m]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left)


def narrow(x: np.ndarray) -> np.ndarray:
    """x in the fewest bytes a number that hold it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype("<i2" if -(1 << 15) <= low and high < 1 << 15 else "<i4" if -(1 << 31) <= low and high < 1 << 31 else "<i8")


def widened(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // max(1, rows * width) or 8}").reshape(rows, width).astype(np.int64)


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of so many, the last of fewer, whatever the size that Spark hands on."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.concat_batches(held)
            cut = n - n % rows
            yield from (whole.slice(at, rows) for at in range(0, cut, rows))
            held, n = [whole.slice(cut)], n - cut
    if n:
        yield pa.concat_batches(held)


def packed_rows(table: DataFrame, width: int, centres: np.ndarray) -> DataFrame:
    """Blocks of at most ROWS encoded rows: their numbers, ids, labels, codes, residual norms and vectors as bytes."""
    shared = table.sparkSession.sparkContext.broadcast(centres)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_blocks(batches, ROWS):
            x = matrix(part.column(3), width)
            codes, left = encode(x, shared.value)
            fields = [part.column(c).to_numpy().astype("<i8") for c in range(3)] + [codes, left.astype("<f8"), narrow(x)]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary()) for f in fields], ["rows", "ids", "labels", "codes", "left", "vectors"])

    return materialise(table.select("row", "id", "label", "vector").mapInArrow(pack, "rows binary, ids binary, labels binary, codes binary, left binary, vectors binary"), "encoded")


def packed_anchors(asked: DataFrame, width: int) -> DataFrame:
    """Blocks of at most ANCHORS anchors (row, id, label, vector, wants: array of struct(rank, low, high))."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_blocks(batches, ANCHORS):
            wants = part.column(4)
            of = np.repeat(np.arange(part.num_rows), np.diff(wants.offsets.to_numpy()))
            ranges = [f.to_numpy(zero_copy_only=False).astype("<i8") for f in wants.flatten().flatten()]
            fields = [part.column(c).to_numpy().astype("<i8") for c in range(3)] + [matrix(part.column(3), width).astype("<i8"), of.astype("<i8"), *ranges]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary()) for f in fields], [f"a{i}" for i in range(8)])

    return asked.select("row", "id", "label", "vector", "wants").mapInArrow(pack, ", ".join(f"a{i} binary" for i in range(8)))


class Search:
    """The first rows of each want of a block of anchors, over the blocks of rows that one task meets."""

    def __init__(self, fields: list[bytes], centres: np.ndarray, width: int, most: int, same: bool):
        self.rows, self.ids, self.labels, x, self.of, self.rank, self.low, self.high = (np.frombuffer(f, "<i8") for f in fields)
        self.x, self.most, self.same, self.width = x.reshape(len(self.rows), width), most, same, width
        self.norms = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.largest = float(np.abs(self.x.astype(np.float64)).max(initial=0))
        self.centres, self.wanted = centres, np.searchsorted(self.of, np.arange(len(self.rows) + 1))
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.best = [np.zeros((3, 0), np.int64)] * len(self.of)  # scores, ids and rows, the first ones first

    def add(self, fields: list[bytes]) -> None:
        rows, ids, labels = (np.frombuffer(f, "<i8") for f in fields[:3])
        n = len(rows)
        codes, left, y = np.frombuffer(fields[3], np.uint8).reshape(-1, n), np.frombuffer(fields[4], "<f8"), widened(fields[5], n, self.width)
        small = self.width * self.largest * float(np.abs(y.astype(np.float64)).max(initial=0)) < 1 << 53
        exact = y.astype(np.float64) if small else y  # whole numbers below 2**53 are exact as doubles
        reach = np.sqrt((y.astype(np.float64) ** 2).sum(axis=1)) + left
        step = max(1, (1 << 21) // max(1, len(codes) * CENTRES, n))
        for label in np.unique(self.labels).tolist():
            who, these = np.flatnonzero(self.labels == label), np.flatnonzero((labels == label) == self.same)
            if not len(these):
                continue
            part, far = np.ascontiguousarray(codes[:, these]), left[these] + SLACK * reach[these]
            for first in range(0, len(who), step):
                some = who[first : first + step]
                table, largest = self.tables(label, first, some)
                score = np.zeros((len(some), len(these)), table.dtype)
                for m in range(len(codes)):
                    score += table[m].take(part[m], axis=1)
                width = self.norms[some][:, None] * far + (len(codes) + 1) * 2.0**-23 * largest[:, None] + SLACK
                below, above = score - width, score + width
                for i, low, high in zip(some.tolist(), below, above):
                    self._meet(i, low, high, these, rows, ids, exact)

    def _meet(self, i: int, low: np.ndarray, high: np.ndarray, these: np.ndarray, rows: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        """All wants of anchor i over the rows these of one block."""
        wants = range(self.wanted[i], self.wanted[i + 1])
        lowest, highest = min((self.floor(w) for w in wants), default=math.inf), max((int(self.high[w]) for w in wants), default=-math.inf)
        near = np.flatnonzero((high >= lowest) & (low <= highest))
        near = near[rows[these[near]] != self.rows[i]]
        if len(near):
            for w in wants:
                self._first(w, i, low[near], high[near], these[near], rows, ids, exact)

    def floor(self, w: int) -> float:
        """What a row has to score at least to be among the first of a want, as far as is known."""
        had, least = self.best[w], float(self.low[w])
        if had.shape[1] < self.most:
            return least
        last = float(had[0, -1])
        return max(least, last - SLACK * abs(last))

    def tables(self, label: int, first: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, anchors, CENTRES): the inner products of some anchors' parts with all centres, and for each anchor the
        sum of their largest sizes; kept for all blocks if that takes less than KEPT bytes."""
        made = self.kept.get((label, first))
        if made is None:
            table = np.einsum("mcp,map->mac", self.centres, parts(self.x[some]))
            largest = np.abs(table).max(axis=2, initial=0).sum(axis=0)
            made = table.astype(np.float32 if largest.max(initial=0) < 1e30 else np.float64), largest
            if len(self.rows) * self.centres[..., 0].size * 4 <= KEPT:
                self.kept[label, first] = made
        return made

    def _first(self, w: int, i: int, low: np.ndarray, high: np.ndarray, some: np.ndarray, rows: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        """Want w of anchor i over the rows some of one block: only those whose interval meets the want and may reach its
        first ones are scored."""
        a, b, had = int(self.low[w]), int(self.high[w]), self.best[w]
        near = np.flatnonzero((low <= b) & (high >= self.floor(w)))
        if len(near) > self.most:
            sure = low[near][(low[near] >= a) & (high[near] <= b)]
            if len(sure) >= self.most:
                near = near[high[near] >= np.partition(sure, len(sure) - self.most)[len(sure) - self.most]]
        if not len(near):
            return
        at = some[near]
        if exact.dtype == np.float64:
            score = (exact[at] @ self.x[i].astype(np.float64)).astype(np.int64)
        else:
            score = (exact[at] * self.x[i]).sum(axis=1)
        fits = (score >= a) & (score <= b)
        met = np.concatenate([had, np.stack([score[fits], ids[at[fits]], rows[at[fits]]])], axis=1)
        self.best[w] = met[:, np.lexsort((met[2], met[1], -met[0]))[: self.most]]

    def found(self) -> pa.RecordBatch:
        n = [b.shape[1] for b in self.best]
        w = np.repeat(np.arange(len(self.best)), n)
        i, flat = self.of[w], np.concatenate([np.zeros((3, 0), np.int64), *self.best], axis=1)
        columns = [self.rows[i], self.ids[i], self.rank[w], self.high[w], *flat]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], FOUND)


FOUND = ["anchor", "anchor_id", "want", "high", "score", "id", "row"]


def first_in_windows(asked: DataFrame, blocks: DataFrame, centres: np.ndarray, width: int, most: int, same: bool) -> DataFrame:
    """anchor, anchor_id, want, high, score, id, row, rank: for each want of each anchor the first most rows, by score
    descending and id, whose score is within (low, high) and whose label is the same as the anchor's, or another.

    The blocks are dealt to a grid of groups; each group of anchors meets each group of rows in one task, which hands
    on the first rows of each want only.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    asked = asked.repartition(max(1, asked.count() // ANCHORS))
    anchors = materialise(packed_anchors(asked, width), "anchors")
    n_rows, n_anchors = blocks.count(), anchors.count()
    groups = max(1, min(n_rows, max(2 * spark.sparkContext.defaultParallelism, n_rows // 32)))
    sides = max(1, n_anchors // 16)
    dealt = lambda k, name: F.pmod(F.monotonically_increasing_id(), F.lit(k)).alias(name)
    every = lambda k, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias(name)
    pairs = anchors.select("*", dealt(sides, "side"), every(groups, "group")).join(blocks.select("*", dealt(groups, "group"), every(sides, "side")), ["side", "group"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, Search] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                fields = [batch.column(c)[r].as_py() for c in range(14)]
                if fields[0] not in met:
                    met[fields[0]] = Search(fields[:8], shared.value, width, most, same)
                met[fields[0]].add(fields[8:])
        for one in met.values():
            yield one.found()

    found = pairs.select(*(f"a{i}" for i in range(8)), "rows", "ids", "labels", "codes", "left", "vectors").mapInArrow(search, ", ".join(f"{c} long" for c in FOUND))
    order = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "id", "row")
    out = materialise(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most), "first-in-windows")
    discard(anchors)
    return out


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor, components being floor(scale * x). An anchor's
    positives are its first other rows of its label; the negatives of a positive its first rows of another label with
    percent * positive_score <= 100 * score <= 100 * positive_score. Higher scores come first, ties by the smaller id,
    a null id last. Rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors
    end in zeros. Rows that share an id are rows of their own, so an anchor that is there twice is answered twice. ids
    and labels are whole numbers, 2**63 - 1 being no id, and scores have to fit in 64 bits. An empty table, and one
    without anchors, gives an empty table; other columns are not read.
    """
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    table = whole_vectors(plain, "id", "vector", "label", scale)
    width = table.agg(F.max(F.size("vector"))).first()[0] or 0
    some = table.select("vector", F.xxhash64("id").alias("hash"), "row").orderBy("hash", "row").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    centres = fit_centres(matrix(some, width))
    blocks = packed_rows(table, width, centres)
    spark = rows.sparkSession
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    spark.conf.set(key, "4")  # a row is a block of rows with a block of anchors
    try:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("rank"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
        own = table.filter("anchor").select("row", "id", "label", "vector")
        near = first_in_windows(own.withColumn("wants", whole), blocks, centres, width, positives, True)
        low = F.ceil(F.col("score").cast("decimal(38,0)") * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
        wants = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), low.alias("low"), F.col("score").alias("high")))).alias("wants"))
        found = first_in_windows(own.join(wants, F.col("row") == F.col("anchor")), blocks, centres, width, negatives, False)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    discard(blocks)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    chosen = near.select("anchor", F.col("rank").cast("long").alias("want"), known("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.withColumnRenamed("score", "negative_score").join(chosen, ["anchor", "want"]).select(
        known("anchor_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", "negative_score"
    )
