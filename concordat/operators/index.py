"""A keyword index that is stored: postings in buckets by term, weights of terms, lengths of groups; and a key-value store.

The corpus is split into terms once, when the index is written. A search names the buckets of its terms, so that the
scan opens those folders only; their files are sorted by term. Postings are dealt by bucket and a hash of the key, so that
a term in every document fills several files instead of one task, and a folder has as many files at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators.documents import small_batches

#: Folders of postings; a search lists at most so many numbers on the driver. Files of a folder at most.
BUCKETS, SLICES = 64, 8
#: Fixed values of the scoring.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """postings: bucket, term, group, key, tf, length; terms: bucket, group, term, df, idf; groups: group, n_docs,
    mean_length, mean_idf."""

    postings: DataFrame
    terms: DataFrame
    groups: DataFrame
    buckets: int


def cut_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of texts one after another, the place of the text of each, and how many each text has."""
    cut = pc.ascii_split_whitespace(texts)
    term, text = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
    some = pc.not_equal(term, "")
    text = text[some.to_numpy(zero_copy_only=False)]
    return term.filter(some), text, np.bincount(text, minlength=len(cut)).astype(np.int32)


def counted_terms(texts: DataFrame) -> DataFrame:
    """group, key, length, term and tf of rows of group, key and texts: what a row's texts of one length hold together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, text, length = cut_terms(batch.column("texts").flatten())
            row = pc.list_parent_indices(batch.column("texts")).to_numpy()
            (row, length), document = np.unique(np.stack([row, length]), axis=1, return_inverse=True)
            found = pa.table({"document": document.ravel()[text], "term": term}).group_by(["document", "term"], use_threads=False).aggregate([([], "count_all")])
            for part in found.to_batches():
                of = part.column("document").to_numpy()
                at = pa.array(row[of])
                columns = [batch.column("group").take(at), batch.column("key").take(at), pa.array(length[of].astype(np.int32)), part.column("term"), part.column("count_all")]
                yield pa.RecordBatch.from_arrays(columns, ["group", "key", "length", "term", "tf"])

    kinds = (texts.schema[c].dataType.simpleString() for c in ("group", "key"))
    return small_batches(texts).mapInArrow(count, "`group` {}, key {}, length int, term string, tf bigint".format(*kinds))


def text_lengths(docs: DataFrame) -> DataFrame:
    """group and n, the number of terms, of each row of group and text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(cut_terms(batch.column("text"))[2])], ["group", "n"])

    return small_batches(docs).mapInArrow(measure, f"`group` {docs.schema['group'].dataType.simpleString()}, n int")


def in_folders(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by bucket and a hash of by, so that a folder has at most SLICES files, whatever the number of tasks."""
    return rows.repartition("bucket", F.pmod(F.xxhash64(*by), F.lit(SLICES)))


def write_index(docs: DataFrame, path: str, key: str, group: str, text: str = "text", buckets: int = BUCKETS) -> None:
    """Store an index of the texts of docs. Terms are split at white space, case kept; a null text has none.

    A term in more than half of a group's documents has EPSILON times the mean weight of the group's terms instead of
    its negative one. Rows that share a key are one document of their added terms only if they share a text's length.
    Terms are counted where the text is read; texts are shuffled only if a key of a group comes twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if rows.groupBy("group", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).isEmpty():
        texts = rows.select("group", "key", F.array("text").alias("texts"))
    else:
        texts = rows.groupBy("group", "key").agg(F.collect_list("text").alias("texts"))
    postings = counted_terms(texts).withColumn("bucket", bucket(F.col("term"), buckets))
    in_folders(postings, "key").sortWithinPartitions("bucket", "term", "group", "key").write.partitionBy("bucket").parquet(f"{path}/postings")
    sizes = text_lengths(rows.select("group", "text")).groupBy("group").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_length"))
    sizes.write.parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")
    postings = spark.read.parquet(f"{path}/postings")
    df = postings.groupBy("bucket", "group", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes.select("group", "n_docs"), "group")
    weights = df.select("bucket", "group", "term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    in_folders(weights, "term", "group").write.partitionBy("bucket").parquet(f"{path}/terms")
    means = spark.read.parquet(f"{path}/terms").groupBy("group").agg(F.avg("raw").alias("mean_idf"), F.count(F.lit(1)).alias("n_terms"))
    sizes.join(means, "group", "left").write.parquet(f"{path}/groups")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def open_index(spark: SparkSession, path: str) -> Index:
    groups = spark.read.parquet(f"{path}/groups")
    weight = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    terms = spark.read.parquet(f"{path}/terms").join(groups.select("group", "mean_idf"), "group").select("bucket", "group", "term", "df", weight.alias("idf"))
    return Index(spark.read.parquet(f"{path}/postings"), terms, groups, spark.read.parquet(f"{path}/layout").first()[0])


def asked_terms(queries: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """query_id, term and its bucket, once each."""
    words = F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return queries.select("query_id", F.explode(words).alias("term")).withColumn("bucket", bucket(F.col("term"), buckets))


def search(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, group, key, score of the documents that share a term with a query, by Okapi BM25 within each group.

    Only the buckets of the queries' terms are read. The queries and the weights of their terms, which do not grow with
    the documents, are broadcast. Postings are dealt by document before they meet the queries, so that what is shuffled
    are the postings of asked terms, and not a row for each of them and query.
    """
    asked = asked_terms(queries, index.buckets)
    wanted = [r[0] for r in asked.select("bucket").distinct().collect()]
    here = F.col("bucket").isin(wanted) if wanted else F.lit(False)
    terms = asked.select("term", "bucket").distinct()
    idf = index.terms.filter(here).join(terms, ["bucket", "term"], "left_semi").join(index.groups.select("group", "mean_length"), "group")
    met = index.postings.filter(here).join(F.broadcast(idf.drop("df")), ["bucket", "group", "term"])
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    dealt = met.select("term", "group", "key", weight.alias("weight")).repartition("group", "key")
    scored = dealt.join(F.broadcast(asked.select("query_id", "term")), "term")
    return scored.groupBy("query_id", "group", "key").agg(F.round(F.sum("weight"), 6).alias("score"))


def put(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Store each row of rows as a JSON document under its key; equal keys go to one folder, dealt by ranges."""
    value = F.to_json(F.struct(*(c for c in rows.columns if c != key)), {"ignoreNullFields": "false"})
    plain = rows.select(F.col(key).alias("key"), value.alias("value")).withColumn("bucket", bucket(F.col("key").cast("string"), buckets))
    plain.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.mode(mode).partitionBy("bucket").parquet(path)


def get(spark: SparkSession, path: str, keys: DataFrame, key: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """keys with found (whether the store has the key) and the fields of its document, null where it is not there or is
    no JSON of the schema. Only the buckets of the keys are read; keys may be many."""
    asked = keys.withColumn("_bucket", bucket(F.col(key).cast("string"), buckets))
    wanted = [r[0] for r in asked.select("_bucket").distinct().collect()]
    held = spark.read.parquet(path).filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))
    held = held.select(F.col("bucket").alias("_bucket"), F.col("key").alias(key), F.lit(True).alias("found"), F.from_json("value", schema).alias("_fields"))
    met = asked.join(held, ["_bucket", key], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return met.select(*keys.columns, "found", "_fields.*")
