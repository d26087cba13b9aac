"""What the corpus operators share."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters outside of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A batch of long texts takes so many bytes, whatever the number of its rows.
ARROW_BYTES = 8 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, bounds Arrow batches by bytes, and sets the checkpoint folder that the session names.

    A session without one gets its own only where all of Spark is one process (master local); elsewhere the folder
    has to be shared, so its lack is an error.
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return spark


def let(value: Column, body) -> Column:
    """Binds value to a lambda variable, so that body's uses of it evaluate it once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lean(run):
    """run, for mapInArrow, but what Arrow has freed goes back after each batch and at the end: a Python worker outlives its tasks, and idle ones count beside the JVM."""

    def given_back(batches):
        for b in batches:
            yield b
            del b
            pa.default_memory_pool().release_unused()

    def leaner(batches):
        yield from run(given_back(batches))
        pa.default_memory_pool().release_unused()

    return leaner
