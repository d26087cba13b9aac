"""New files as a stream: each micro-batch is turned into sections and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FILES = "path string, modificationTime timestamp, length long, content binary"


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files landing in a folder, as path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", 100).load(path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Writes path, n_lines and file_hash of each new file once; the checkpoint remembers what was read."""
    rows = page_stream(spark, source).select(
        "path", F.size(F.split(F.decode("content", "utf-8"), "\n")).alias("n_lines"), F.sha2("content", 256).alias("file_hash")
    )
    return append_new(rows, target, checkpoint)


def windowed_counts(events: DataFrame, at: str, by: str, size: str, late: str) -> DataFrame:
    """Counts by tumbling window, with late rows let in up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A Parquet table of a folder, one file or a folder of files, as a stream of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def append_new(rows: DataFrame, target: str, checkpoint: str):
    """Appends what a stream has not delivered yet, as Parquet; the checkpoint remembers what was read."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
