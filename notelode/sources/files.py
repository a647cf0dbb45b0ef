"""Directories of text files as a table, and concepts as one JSON file per record."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def universal_newlines(text: Column) -> Column:
    """Line ends as a text-mode read gives them: CRLF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def record_id(file_name: Column) -> Column:
    """Stem of the last path component, leading zeros kept; null for a name that doesn't end in .txt."""
    found = F.regexp_extract(file_name, r"([^/]*)\.txt\z", 1)
    return F.when(file_name.endswith(".txt"), found)


def _names(scan: DataFrame) -> DataFrame:
    """path of every file a scan looks at. Names go from the file index into a table within the JVM, none through Python."""
    spark, jvm = scan.sparkSession, scan.sparkSession.sparkContext._jvm
    found = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles())
    names = DataFrame(spark._jsparkSession.createDataset(found, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # The index gives names as in a URI, in which a plus is one.
    return names.select(F.url_decode(F.regexp_replace("value", r"\+", "%2B")).alias("path"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """record_id, text, size of every *.txt right in a directory; invalid UTF-8 raises, a byte-order mark stays.

    A scan leaves out empty files; they are those of the index that it didn't give.
    """
    scan = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    full = scan.select("path", F.decode(F.col("content"), "UTF-8").alias("text"), F.col("length").alias("size"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    empty = _names(scan).select(bare(F.col("path")).alias("path")).join(scan.select(bare(F.col("path")).alias("path")), "path", "left_anti")
    empty = empty.select("path", F.lit("").alias("text"), F.lit(0).cast("long").alias("size"))
    both = full.unionByName(empty)
    return both.select(record_id(F.col("path")).alias("record_id"), universal_newlines(F.col("text")).alias("text"), "size")


def numeric_order(record: Column) -> Column:
    """Sort key of records by number; null for a stem that isn't one."""
    return record.try_cast("decimal(38,0)")


def in_file_order(notes: DataFrame) -> DataFrame:
    """Notes by number of their record; any stem that isn't a number raises when the plan runs."""
    key = numeric_order(F.col("record_id"))
    checked = F.when(key.isNotNull(), key).otherwise(
        F.raise_error(F.concat(F.lit("not a number: "), F.col("record_id"))).cast("decimal(38,0)")
    )
    return notes.orderBy(checked, "record_id")


def _content(concepts: Sequence | None) -> bytes:
    """A file's content: concepts as JSON, fields that are null left out."""
    # Arrays come as NumPy's from a batch.
    listed = lambda v: v.tolist() if hasattr(v, "tolist") else list(v) if isinstance(v, (list, tuple)) else v
    out = [{k: listed(v) for k, v in c.items() if v is not None} for c in (concepts if concepts is not None else [])]
    return json.dumps(out, ensure_ascii=False, indent=2).encode()


def write_json_files(concepts: DataFrame, directory: str) -> int:
    """Write <record_id>.json for each row of record_id, concepts; returns how many.

    The directory is made if there is none. It may lie on any file system that both Spark's and Arrow's drivers reach
    (local or mounted, hdfs, s3, gcs), and must be shared by the executors.
    """
    spark = concepts.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(conf)
    fs.mkdirs(at)
    # Hadoop writes a local name with one slash, Arrow wants three.
    target = re.sub("^file:/+", "file:///", fs.makeQualified(at).toString())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow

        store, base = arrow.FileSystem.from_uri(target)
        for b in batches:
            for record, found in zip(b["record_id"], b["concepts"], strict=True):
                name = f"{base}/{record}.json"
                # A task that is run again replaces its files whole, so readers never see half of one.
                temporary = f"{name}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(temporary) as f:
                    f.write(_content(found))
                store.move(temporary, name)
            yield pd.DataFrame({"n": [len(b)]})

    done = concepts.select("record_id", "concepts").mapInPandas(write, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0
