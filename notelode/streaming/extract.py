"""The extractor on streams: the same narrow plan, exactly once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from notelode.plans.pipeline import concept_rows


def read_notes(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the Parquet files in a folder, or of one file; a stream's source is a folder in either case."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    reader = spark.readStream.schema(schema)
    if status.isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


def concept_stream(notes: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per concept; stateless, so late and unordered notes need no watermark."""
    return concept_rows(notes, keys, text)


def deduplicated(notes: DataFrame, keys: list[str], at: str, late: str = "60 days") -> DataFrame:
    """First arrival of each key; state is dropped once a row is later than the watermark allows."""
    return notes.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(concepts: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Concepts per type and tumbling window of event time."""
    return (
        concepts.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "type", "n")
    )


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
