"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily from each query.

The graph starts from small groups of rows that lie on the same sides of random planes. In each round every row is a
meeting place for its neighbours and for the rows that it is a neighbour of: their distances to each other propose new
neighbours, which is what joining neighbours of neighbours comes to, and each row keeps the nearest. Every row is in
the graph. Queries then walk: a beam of the nearest rows so far, whose neighbours are joined in round by round until no
row of the beam is unexpanded. Distances of the search are those of the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.stage import discard, materialise

#: Neighbours of a row in the graph, and rows of each kind (new or old, to or from) that meet at one.
DEGREE, MEET = 24, 10
#: Rounds of the descent at most, and the part of new links below which it ends.
ROUNDS, STILL = 6, 0.08
#: Rows of a group of the start, groupings, and planes.
GROUP, GROUPINGS, PLANES = 512, 2, 24
#: Rows of a query's beam, how many of them are expanded at once, and rows from which every query sets out besides.
BEAM, EXPAND, ENTRIES = 512, 128, 16
#: Meeting places that are computed at once.
AT_ONCE = 256
#: A link is old, takes part in the next round, or waits.
OLD, PICKED, WAITING = 0, 1, 2


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def usable(rows: DataFrame, id_col: str, vector_col: str, queries: Column) -> tuple[DataFrame, int]:
    """row, id, vector, query of the rows that take part, written once, and the length of vectors; row tells rows apart."""
    x = F.col(vector_col)
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    known = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists(x, lambda v: v != 0), F.lit(False))
    table = rows.filter(known).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), x.alias("vector"), F.coalesce(queries, F.lit(False)).alias("query"))
    table = materialise(table, "vectors")
    low, width = table.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != width:
        zeros = F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size("vector"))
        table = materialise(table.withColumn("vector", F.concat("vector", zeros)), "vectors")
    return table, width or 0


def first_links(points: DataFrame, width: int, degree: int, seed: int) -> DataFrame:
    """node, other, d: for each row its nearest in a group of GROUP rows; rows on the same sides of planes are together.

    Rows are sorted by their sides and then by a hash, so that groups are even however many rows are alike.
    """
    planes = np.random.default_rng(seed).standard_normal((width, PLANES))
    bits = 1 << np.arange(PLANES)[::-1]

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = (matrix(batch.column(1), width) @ planes > 0) @ bits
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], ["node", "vector", "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, x in groups(batches):
            d = distances(x[None])[0]
            np.fill_diagonal(d, math.inf)
            k = min(degree, len(node) - 1)
            at = np.argpartition(d, k - 1, axis=1)[:, :k] if 0 < k < len(node) - 1 else np.argsort(d, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, k)), pa.array(node[at.ravel()]), pa.array(np.take_along_axis(d, at, 1).ravel())], ["node", "other", "d"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nodes, held, n = [], [], 0
        for batch in batches:
            nodes.append(batch.column(0).to_numpy())
            held.append(matrix(batch.column(1), width))
            n += batch.num_rows
            if n >= 2 * GROUP:
                node, x = np.concatenate(nodes), np.concatenate(held)
                whole = (n - GROUP) // GROUP * GROUP
                for a in range(0, whole, GROUP):
                    yield node[a : a + GROUP], x[a : a + GROUP]
                nodes, held, n = [node[whole:]], [x[whole:]], n - whole
        if n > 1:
            node, x = np.concatenate(nodes), np.concatenate(held)
            size = -(-n // -(-n // GROUP)) if n > GROUP else n
            for a in range(0, n, size):
                yield node[a : a + size], x[a : a + size]

    kind = points.schema["vector"].dataType.simpleString()
    spread = max(1, min(points.count() // (8 * GROUP), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    coded = points.select(F.col("row").alias("node"), "vector").mapInArrow(sides, f"node long, vector {kind}, code long")
    order = ["code", F.xxhash64("node", F.lit(seed))]
    return coded.repartitionByRange(spread, *order).sortWithinPartitions(*order).select("node", "vector").mapInArrow(near, "node long, other long, d double")


def distances(x: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of each of some sets of vectors, (sets, rows, width)."""
    square = (x * x).sum(axis=2)
    return np.maximum(square[:, :, None] + square[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)


def trimmed(links: DataFrame, degree: int, seed: int, meet: int) -> DataFrame:
    """The nearest degree others of each node, once each; of the links that are not old, meet are picked for the next round."""
    once = links.repartition("node").groupBy("node", "other").agg(F.min("d").alias("d"), F.min("state").alias("state"))
    near = once.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))).filter(F.col("place") <= degree)
    drawn = F.row_number().over(Window.partitionBy("node").orderBy(F.col("state") == OLD, F.xxhash64("node", "other", F.lit(seed))))
    state = F.when(F.col("state") == OLD, OLD).when(F.col("drawn") <= meet, PICKED).otherwise(WAITING)
    return materialise(near.withColumn("drawn", drawn).select("node", "other", "d", state.alias("state"), "place"), "graph")


def proposals(graph: DataFrame, points: DataFrame, width: int, degree: int, seed: int, meet: int) -> DataFrame:
    """node, other, d, state: what the rows that meet at each row are to each other, where it betters what they have.

    At most meet rows of each kind meet at one row, drawn by a hash; Spark cuts the lists of rows that very many point
    at before they are shuffled.
    """
    live = graph.filter(F.col("state") != WAITING)
    ways = live.select(F.col("node").alias("pivot"), F.col("other").alias("member"), F.col("state").alias("kind"))
    back = live.select(F.col("other").alias("pivot"), F.col("node").alias("member"), (F.col("state") + 2).alias("kind"))
    drawn = F.row_number().over(Window.partitionBy("pivot", "kind").orderBy(F.xxhash64("pivot", "member", F.lit(seed))))
    lists = ways.unionByName(back).withColumn("drawn", drawn).filter(F.col("drawn") <= meet)
    lists = lists.groupBy("pivot", "member").agg(F.max(F.col("kind") % 2).alias("fresh"))
    worst = graph.filter(F.col("place") == degree).select(F.col("node").alias("member"), F.col("d").alias("worst"))
    held = points.select(F.col("row").alias("member"), "vector").join(worst, "member", "left").withColumn("worst", F.coalesce("worst", F.lit(math.inf)))
    met = lists.join(held, "member").select("pivot", "member", "fresh", "worst", "vector").repartition("pivot").sortWithinPartitions("pivot")

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows of about AT_ONCE whole pivots: where each pivot begins, member, fresh, worst, vectors."""
        rest = None
        for batch in batches:
            got = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy() > 0, batch.column(3).to_numpy(), matrix(batch.column(4), width)]
            rest = got if rest is None else [np.concatenate([a, b]) for a, b in zip(rest, got)]
            begins = np.flatnonzero(np.concatenate([[True], rest[0][1:] != rest[0][:-1]]))
            whole = (len(begins) - 1) // AT_ONCE * AT_ONCE
            for a in range(0, whole, AT_ONCE):
                here = slice(begins[a], begins[a + AT_ONCE])
                yield begins[a : a + AT_ONCE] - begins[a], *(c[here] for c in rest[1:])
            rest = [c[begins[whole] :] for c in rest]
        if rest is not None and len(rest[0]):
            yield np.flatnonzero(np.concatenate([[True], rest[0][1:] != rest[0][:-1]])), *rest[1:]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begins, member, fresh, worst, x in meetings(batches):
            n = np.diff(np.append(begins, len(member)))
            for some in np.array_split(np.arange(len(n)), -(-len(n) // AT_ONCE)):
                rows = np.arange(begins[some[0]], begins[some[0]] + n[some].sum())
                most = n[some].max()
                filled = np.arange(most) < n[some][:, None]
                place = np.zeros(filled.shape, np.int64)
                place[filled] = rows
                new = fresh[place] & filled
                d = distances(x[place])
                ok = (new[:, :, None] | new[:, None, :]) & filled[:, :, None] & filled[:, None, :] & (d < worst[place][:, :, None])
                ok &= member[place][:, :, None] != member[place][:, None, :]
                g, i, j = np.nonzero(ok)
                found = np.stack([member[place[g, i]], member[place[g, j]]])
                value = d[g, i, j]
                order = np.lexsort((value, found[1], found[0]))
                found, value = found[:, order], value[order]
                once = np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(axis=0)]) if len(value) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(found[0][once]), pa.array(found[1][once]), pa.array(value[once])], ["node", "other", "d"])

    return met.mapInArrow(join, "node long, other long, d double").withColumn("state", F.lit(WAITING))


def neighbour_graph(points: DataFrame, width: int, degree: int = DEGREE, meet: int = MEET, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """node, other, d (squared), state, place: about the nearest degree others of every row of points (row, vector)."""
    start = first_links(points, width, degree, 0)
    for seed in range(1, GROUPINGS):
        start = start.unionByName(first_links(points, width, degree, seed))
    graph = trimmed(start.withColumn("state", F.lit(WAITING)), degree, 0, meet)
    for seed in range(1, rounds + 1):
        better = proposals(graph, points, width, degree, seed, meet)
        before = graph.select("node", "other", "d", F.when(F.col("state") == PICKED, OLD).otherwise(F.col("state")).alias("state"))
        old, graph = graph, trimmed(before.unionByName(better), degree, seed, meet)
        discard(old)
        live, all_links = graph.agg(F.sum((F.col("state") != OLD).cast("long")), F.count(F.lit(1))).first()
        if not all_links or live <= still * all_links:
            break
    return graph


def greedy_search(points: DataFrame, graph: DataFrame, width: int, k: int, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """query (row), row, id, d (squared), place: the nearest k rows that each query of points (row, id, vector, query) finds.

    A query sets out from its own links and from ENTRIES rows that are the same for all. Each round joins in the
    neighbours of the expand nearest unexpanded rows of its beam; the search ends when the beams have no other.
    """
    asked = materialise(points.filter("query").select(F.col("row").alias("query"), F.col("vector").alias("asked")), "asked")
    adjacent = materialise(graph.groupBy("node").agg(F.collect_list("other").alias("others")), "adjacent")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = ((matrix(batch.column(4), width) - matrix(batch.column(3), width)) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d)], ["query", "row", "id", "d"])

    kind = points.schema["id"].dataType.simpleString()

    def measured(pairs: DataFrame) -> DataFrame:
        met = pairs.join(points.select("row", "id", "vector"), "row").join(asked, "query").filter(F.col("query") != F.col("row"))
        return met.select("query", "row", "id", "vector", "asked").mapInArrow(measure, f"query long, row long, id {kind}, d double").withColumn("done", F.lit(False))

    def cut(rows: DataFrame) -> DataFrame:
        order = ["d", F.col("id").isNull(), "id", "row"]
        kept = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= beam)
        turn = F.row_number().over(Window.partitionBy("query").orderBy("done", *order))
        return materialise(kept.withColumn("next", ~F.col("done") & (turn <= expand)), "beams")

    entries = points.select("row", F.xxhash64("row").alias("hash")).orderBy("hash", "row").limit(ENTRIES).select("row")
    own = asked.join(adjacent, F.col("query") == F.col("node")).select("query", F.explode("others").alias("row"))
    starts = own.unionByName(asked.select("query").join(F.broadcast(entries))).distinct()
    beams = cut(measured(starts))
    while not (ahead := beams.filter("next").select("query", F.col("row").alias("node"))).isEmpty():
        steps = ahead.join(adjacent, "node").select("query", F.explode("others").alias("row")).distinct()
        new = measured(steps.join(beams.select("query", "row"), ["query", "row"], "left_anti"))
        seen = beams.select("query", "row", "id", "d", (F.col("done") | F.col("next")).alias("done"))
        old, beams = beams, cut(seen.unionByName(new))
        discard(old)
    discard(adjacent)
    return beams.filter(F.col("place") <= k).select("query", "row", "id", "d", "place")


def nearest_neighbours(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row for which queries is true, itself left out.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id, a null id
    last. Rows whose vector is null, zero or empty or holds null or non-finite components take no part; shorter vectors
    end in zeros. Rows that share an id, or a vector, are rows of their own: a query that is there twice is answered
    twice, and finds its double. A table of no more than k others gives all of them. An empty table, and one without
    queries, gives an empty table; other columns are not read.
    """
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), queries.alias("_query"))
    points, width = usable(plain, "id", "vector", F.col("_query"))
    found = greedy_search(points, neighbour_graph(points, width), width, k)
    names = points.filter("query").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return found.join(names, "query").select("query_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.sqrt("d").alias("score"))
