"""Tables between the stages of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Has Spark remove a query's shuffle files as soon as the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables of materialise are.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a folder of this machine, in a local session only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="concordat-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs only tasks of the running stage, and whatever is read twice is
    computed once. Each call writes to a path of its own, so retries and parallel jobs do not meet. The shuffle files
    of the write go when it ends: nothing reads them once the table stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/concordat/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise that nothing reads any more; whatever came of them has to be a table by then."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


def placed_rows(df: DataFrame, name: str) -> DataFrame:
    """df with a column of this name that tells its rows apart and is the same in every job that reads it.

    A row of a Parquet table is known by its file and its place there, however the file is split between tasks. The
    rows of anything else are numbered once, in a table of their own.
    """
    try:
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
    except AnalysisException:
        return materialise(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "placed")


def salted_left_join(rows: DataFrame, groups: DataFrame, key: str, salt_from: str, salts: int = 32) -> DataFrame:
    """rows left-joined with groups (one row a key, no larger than rows) where one key may hold a third of rows.

    The group side is repeated once a salt, so that the rows of a hot key are dealt to as many tasks.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def with_plain_names(docs: DataFrame, step: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """step(docs under names that clash with nothing, those names by the given ones), back under the given names."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return step(docs.toDF(*plain), dict(zip(docs.columns, plain))).select(*plain).toDF(*docs.columns)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Lower the number of rows in an Arrow batch, so that long texts do not add up to one large batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
