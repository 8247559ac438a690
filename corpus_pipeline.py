"""A corpus pipeline: language identification, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, whatever other columns there are and however
they are named. An empty table gives an empty table in every stage; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import exact, jaccard, langid, lines, packing
from concordat.llm.stage import materialise, placed_rows, with_plain_names

#: Documents whose language is less sure are rejected, as are those without letters.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language; lang keeps its given value.

    Null and empty texts and those without letters are in none and go. Each row is judged by its text alone, so rows
    that share an id or a text do no harm. Where no document has a label nothing can be learned, and all stay.
    """
    net = langid.fit(docs)
    if net is None:
        return docs
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return with_plain_names(docs, lambda d, at: langid.identify(d, net, at["text"]).filter(sure))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts, a null id being smaller than any.

    A null text equals an empty one. Of rows equal in text and id exactly one stays.
    """
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of similar documents: one with the least doc_id, a null id ranking last.

    Rows are told apart by their place in the files of docs, so that repeated and null ids do no harm and every job of
    the stage sees the same places, however it splits the files; only places are joined back. Null, empty and blank
    texts are similar to nothing and stay.
    """

    def step(d: DataFrame, at: dict[str, str]) -> DataFrame:
        rows = placed_rows(d, "row")
        similar = jaccard.similar_documents(rows.select(F.col("row").alias("doc_id"), F.col(at["text"]).alias("text")))
        named = similar.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", F.col(at["doc_id"]).alias("id")), "row")
        least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row"))
        kept = materialise(named.groupBy("component_id").agg(least.alias("least")).select("least.row"), "not-near-copies")
        return rows.join(kept, "row", "left_semi")

    return with_plain_names(docs, step)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines and passages that an earlier document has; n_chars follows, and documents stay.

    Documents rank by doc_id, a null id last; rows that share an id rank alike. Null and empty texts stay as they are;
    a text that has nothing of its own becomes empty.
    """

    def step(d: DataFrame, at: dict[str, str]) -> DataFrame:
        cut = lines.remove_passages(d, at["doc_id"], at["text"])
        if "n_chars" not in at:
            return cut
        n = at["n_chars"]
        return cut.withColumn(n, F.when(F.col("removed").isNull(), F.col(n)).otherwise(F.length(at["text"])).cast(docs.schema["n_chars"].dataType))

    return with_plain_names(docs, step)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with the CRC-32 of their ids.

    A null or empty text is the end id alone; rows that share an id or a text are packed one by one.
    """
    return packing.pack_digest(docs, packing.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: The network's decisions and the tokenizer are beyond SQL; tests/llm/test_pipeline.py compares each stage with a plain
#: version of its rule on tables with null, empty, long and repeated rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
