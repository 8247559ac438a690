"""Files in and out: CSV, per-year files, JSON Lines and JSON documents, and outputs that resume where they stopped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; on this machine in a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="concordat-files-")
    return f"{where.rstrip('/')}/files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends and doubled quotes. Without a schema the types are inferred,
    at the price of one more pass; columns that are not asked for are not parsed."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """The named columns that df has, with a header and no index; timestamps and nulls read back as they were."""
    kept = [c for c in columns if c in df.columns] if columns else df.columns
    df.select(*kept).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').csv(path)


def read_years(spark: SparkSession, folder: str, years: range, schema: str) -> DataFrame:
    """Files named ..._Y{year}... of a folder as one scan with a year column; a year without a file has no rows."""
    files = spark.read.option("header", True).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).schema(schema).csv(folder)
    year = F.regexp_extract(F.col("_metadata.file_path"), r"_Y(\d{4})", 1).cast("int")
    return files.select("*", year.alias("year")).filter(F.col("year").between(years.start, years.stop - 1))


def read_json_lines(spark: SparkSession, path: str, schema: str, first: int | None = None) -> DataFrame:
    """A row for each line that is not blank; with first, so many at most."""
    df = spark.read.schema(schema).json(path)
    return df.limit(first) if first is not None else df


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, null fields kept, other characters than ASCII as they are."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json_map(spark: SparkSession, path: str, value: str = "int") -> DataFrame:
    """key and value of each member of JSON documents that are one object each."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def write_json_documents(df: DataFrame, key: str, path: str) -> None:
    """A JSON object for each row, in folders by key."""
    df.select(F.col(key), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.partitionBy(key).text(path)


def resumed(todo: DataFrame, key: list[str], path: str, work: Callable[[DataFrame], DataFrame], parts: int = 4) -> DataFrame:
    """Append work(rows) for the rows of todo whose key is not yet among the results at path, in several commits, and
    return all results. A run that stops loses at most the commit it was in; the next one takes up what is missing."""
    spark = todo.sparkSession

    def results() -> DataFrame | None:
        path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = path_.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path_)
        return spark.read.parquet(path) if there else None

    for part in range(parts):
        done = results()
        rows = todo.filter(F.pmod(F.xxhash64(*key), F.lit(parts)) == part)
        rows = rows if done is None else rows.join(done.select(*key), key, "left_anti")
        work(rows).write.mode("append").parquet(path)
    return results()


def recomputed(results: DataFrame, problems: DataFrame, key: list[str], again: DataFrame) -> DataFrame:
    """results without the keys of problems, and the rows of again for these."""
    keys = problems.select(*key).distinct()
    return results.join(keys, key, "left_anti").unionByName(again.join(keys, key, "left_semi"))


def read_folders(spark: SparkSession, root: str, glob: str = "*", number: str = r"(\d+)/[^/]*$") -> DataFrame:
    """Files of numbered folders below root in the order of folder number and path: number, path, length and content.

    number is the pattern of a path whose first group is the number; files of other folders are passed over.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    folder = F.nullif(F.regexp_extract("path", number, 1), F.lit("")).cast("int")
    return found.select(folder.alias("number"), "path", "length", "content").filter("number is not null").orderBy("number", "path")


def overwrite_in_place(df: DataFrame, path: str) -> None:
    """Put df in the place of the Parquet table at path, which df may read.

    The new table is written beside the old one and the two are swapped by renames, so readers never see half a table;
    a run that stops between the renames leaves the old one under path.old.
    """
    spark = df.sparkSession
    here, old, new = (spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".old", ".new"))
    df.write.mode("overwrite").parquet(new.toString())
    fs = here.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(here):
        fs.delete(old, True)
        if not fs.rename(here, old):
            raise OSError(f"cannot move {path}")
    if not fs.rename(new, here):
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)
