"""Work over files as they come, in small batches whose results are kept: a run that stops goes on where it was.

The source's offsets are in the stream's checkpoint, and each batch writes a folder of its own in place of whatever an
earlier attempt left there, so that a batch that is tried again has its effect once. A key that an earlier batch has
done is not worked on again, whatever file it comes in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def results(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """What the batches so far have written, without their numbers; nothing where there was none yet."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    try:
        return spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(path).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], kind)


def run(spark: SparkSession, source: str, source_schema: T.StructType, work: Callable[[DataFrame], DataFrame], path: str, key: str, files: int = 1, stop_after: int | None = None) -> int:
    """Work through the files of source that no run has done yet, files of them a batch; the number of batches of this run.

    work turns the new rows of a batch, of keys that no earlier batch has, into results with the key among them; of
    rows that share a key in one batch all are worked on. Results are in path/results, a folder a batch, and the
    offsets in path/checkpoint. A row with a null key is worked on always. With stop_after the run stops after so many
    batches, as it would when it is killed.
    """
    done: list[int] = []

    def batch(rows: DataFrame, number: int) -> None:
        if stop_after is not None and len(done) >= stop_after:
            raise Stopped
        session = rows.sparkSession
        fresh = rows
        if number:
            try:
                earlier = session.read.parquet(f"{path}/results").filter(F.col("batch") < number).select(key).distinct()
                fresh = rows.join(earlier, key, "left_anti")
            except AnalysisException:  # no earlier batch has written anything
                pass
        work(fresh).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        done.append(number)

    stream = spark.readStream.schema(source_schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if stop_after is None or len(done) < stop_after:
            raise
    return len(done)


class Stopped(Exception):
    """A run that was told to stop."""
