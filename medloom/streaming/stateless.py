"""The projections of the library over unbounded input: the same columns work on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.functions import text as T
from medloom.operators.candidates import candidate_terms


def parquet_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def masked(stream: DataFrame, text: str) -> DataFrame:
    return stream.withColumn(text, T.preprocess(F.col(text), emails=True, phones=True))


def candidates(stream: DataFrame, key: str, text: str) -> DataFrame:
    return candidate_terms(stream, key, text)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks want times with a zone; those without count as the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def counted(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows of each kind in each window; rows later than ``late`` are dropped with their window's state."""
    return _timed(stream, time, late).groupBy(F.window(time, window).alias("window"), kind).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", kind, "n")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; a key is forgotten after ``late``."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet and stop; run again for what is new."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def tables_of(aggregated: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; the whole result of a streaming aggregate replaces the table at ``path``."""
    save = lambda rows, batch: rows.write.mode("overwrite").parquet(path)
    aggregated.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
