"""Files as tables, and tables as files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.functions import text as T

#: Dictionary of entities: one row for each system or component.
DICTIONARY = "systems map<string, struct<code: string, canonical: string, keywords: array<string>, aliases: array<string>, abbreviations: array<string>, parent: string>>, components map<string, array<string>>"
#: Questions with expected answers.
EVALUATION = """question string, answer struct<answer_text: string, citations: array<struct<type: string, doc_id: string, section_id: string, page: string, title: string, doc_title: string>>,
  figures: array<struct<url: string, page: int>>, tables: array<struct<url: string, page: int>>>, expected_type struct<primary_type: string, expected_tools: array<string>>"""


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the shared folder that the session names; below the warehouse if it names none and all of Spark is one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows as a table in a new shared folder, so that what reads them begins there."""
    folder = scratch(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and the content's hash."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.sha2("content", 256).alias("file_hash"))


def uploads(rows: DataFrame) -> DataFrame:
    """tags (text with commas) -> array, trimmed and without empty ones."""
    return rows.withColumn("tags", F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t != ""))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """keyword, code of a dictionary file; a file that isn't there is an empty dictionary."""
    try:
        d = spark.read.schema(DICTIONARY).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        d = spark.createDataFrame([], DICTIONARY)
    d = d.select(F.explode("systems").alias("key", "s"))
    words = F.concat(F.coalesce("s.keywords", F.array()), F.coalesce("s.aliases", F.array()), F.array("s.canonical"))
    return d.select(F.explode(F.transform(F.filter(words, lambda w: w.isNotNull()), F.lower)).alias("keyword"), F.coalesce("s.code", F.concat(F.lit("sys_"), "key")).alias("code")).groupBy("keyword").agg(F.max("code").alias("code"))


def evaluation(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Questions with expected answers. whole: a file is one JSON array; else a line holds one question."""
    return spark.read.schema(EVALUATION).json(path, multiLine=whole)


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON file of a small result."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def csv_text(matrix, separator: str = ","):
    """Cells with white space collapsed, as lines of comma-separated text with a byte order mark."""
    line = lambda r: F.array_join(F.transform(r, lambda c: T.collapse_spaces(F.coalesce(c, F.lit("")))), separator)
    return F.concat(F.lit("﻿"), F.array_join(F.transform(matrix, line), "\n"))


def replace_partition(rows: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def vector_rows(rows: DataFrame, text: str, vector: str) -> DataFrame:
    """Rows for a vector collection: long texts cut to 32000 characters, equal texts embedded once, failed (zero) vectors left out."""
    from doclattice.functions import maths as M

    cut = F.when(T.token_estimate(F.col(text)) > 8000, F.left(text, F.lit(32000))).otherwise(F.col(text))
    return rows.where(M.dot(F.col(vector), F.col(vector)) > 0).withColumn(text, cut).withColumn("text_key", F.md5(cut)).withColumn("text_preview", F.left(cut, F.lit(500)))
