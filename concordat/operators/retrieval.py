"""Keyword and vector retrieval within groups, and fusion of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many vectors are compared with as many at a time.
BLOCK = 1024


def term_counts(docs: DataFrame, key: str, group: str, text: str = "text") -> DataFrame:
    """group, key, term, tf and the document's length; terms are split at white space, case kept."""
    terms = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    cut = docs.select(group, key, terms.alias("terms")).withColumn("length", F.size("terms"))  # else lengths are taken again for each term
    return cut.select(group, key, "length", F.explode("terms").alias("term")).groupBy(group, key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, group: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, group, key, score of documents that share a term with a query, by Okapi BM25 within each group.

    A term in more than half of a group's documents has epsilon times the mean weight of the group's terms instead of
    its negative one, so document frequencies are taken over all terms. Scores keep postings of the queries' terms only.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    stats = docs.select(group, F.size(words).alias("n")).groupBy(group).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_length"))
    asked = queries.select("query_id", F.explode(F.array_distinct(words)).alias("term"))
    postings = term_counts(docs, key, group)
    idf = postings.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df")).join(stats, group).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = idf.groupBy(group).agg(F.avg("idf").alias("mean_idf"))
    wanted = asked.select("term").distinct()
    idf = idf.join(wanted, "term", "left_semi").join(means, group).select(group, "term", "mean_length", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = postings.join(wanted, "term", "left_semi").join(idf, [group, "term"]).select("term", group, key, weight.alias("weight"))
    return scored.join(asked, "term").groupBy("query_id", group, key).agg(F.round(F.sum("weight"), 6).alias("score"))


def top_k(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_blocks(df: DataFrame, key: str, vector: str, ids: str, data: str, rows: int, group: str | None = None) -> DataFrame:
    """A row for so many vectors at most: ids in ascending order, and the vectors at length 1 as 64-bit floats. A null
    vector and one of length 0 become NaN; rows without a key are left out. With group all vectors of a row are of one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [0, batch.num_rows]
            if group and batch.num_rows:
                codes = batch.column(2).dictionary_encode().indices.fill_null(-1).to_numpy()
                cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            for at, end in ((a, min(a + rows, z)) for x, z in zip(cuts, cuts[1:]) for a in range(x, z, rows)):
                part = batch.slice(at, end - at)
                part = part.take(pc.sort_indices(part.column(0)))
                known = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                flat = part.column(1).drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.full((len(known), len(flat) // max(1, known.sum())), np.nan)
                x[known] = flat.reshape(known.sum(), x.shape[1])
                length = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x /= np.where(length > 0, length, np.nan)
                lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([lists, pa.array([x.tobytes()], pa.binary()), *(c.slice(0, 1) for c in part.columns[2:])], [ids, data, *([group] if group else [])])

    held = df.filter(F.col(key).isNotNull()).select(key, vector, *([group] if group else []))
    schema = f"{ids} array<{df.schema[key].dataType.simpleString()}>, {data} binary"
    if group:
        held, schema = held.repartitionByRange(group, key).sortWithinPartitions(group, key), f"{schema}, `{group}` {df.schema[group].dataType.simpleString()}"
    return held.mapInArrow(pack, schema)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, rows: int = BLOCK, group: str | None = None) -> DataFrame:
    """The k nearest vectors of each query (query_id, vector) by cosine to six places, itself left out.

    Each block of queries meets each block of vectors and keeps its k best, so that neither side has to fit anywhere
    whole. An unknown cosine is null and ranks last. With group, a column of vectors, the k nearest of each group are
    found, a query's own vector among them, and unknown cosines rank as they do.
    """
    asked = vector_blocks(queries, "query_id", "vector", "query_ids", "asked", rows)
    pairs = asked.crossJoin(vector_blocks(vectors, "vec_id", "embedding", "vec_ids", "held", rows, group))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, vec_ids = batch.column(0)[i].values, batch.column(2)[i].values
                q, v = query_ids.to_numpy(), vec_ids.to_numpy()
                x, y = (np.frombuffer(batch.column(c)[i].as_py()).reshape(n, -1) for c, n in ((1, len(q)), (3, len(v))))
                if 0 in (x.shape[1], y.shape[1]):  # a block of nulls
                    x, y = np.full((len(q), 1), np.nan), np.full((len(v), 1), np.nan)
                cosine = x @ y.T
                cosine = np.copysign(np.floor(np.abs(cosine) * 1e6 + 0.5), cosine) / 1e6
                score = np.where(np.isnan(cosine), -2.0, cosine)
                if not group:
                    score[q[:, None] == v] = -3.0
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # vec_ids ascend: the least of equals comes first
                row, at = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                other = score[row, at] > -3.0
                row, at = row[other], at[other]
                of = [batch.column(4).take(pa.array(np.full(len(row), i)))] if group else []
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(row)), vec_ids.take(pa.array(at)), pa.array(cosine[row, at] + 0.0, from_pandas=True), *of], ["query_id", "vec_id", "cosine", *([group] if group else [])])

    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString())
    schema = "query_id {}, vec_id {}, cosine double".format(*kinds) + (f", `{group}` {vectors.schema[group].dataType.simpleString()}" if group else "")
    return top_k(pairs.mapInArrow(search, schema), ["query_id", *([group] if group else [])], "cosine", "vec_id", k)


def fused(rankings: DataFrame, k: int = 60) -> DataFrame:
    """query_id, parent, score: weighted reciprocal ranks (from 0) added up; a parent may occur several times a list."""
    part = F.col("weight") / (k + F.col("rank"))
    return rankings.groupBy("query_id", "parent").agg(F.round(F.sum(part), 9).alias("score"))
