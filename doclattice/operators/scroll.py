"""Scrolling through a table in pages by a cursor: the last key of the page before.

The table is written once in order of its key, as ranges with fences (a range's first
and last key and its number of rows). A page begins behind the cursor and needs the
ranges up to the one in which enough rows have come, so it reads these, whatever the
page's number and the table's size; a filter that leaves too few rows lets it read on, twice
as many ranges each time. Neither earlier pages nor the rest of the table are read.

cursors() gives the cursors of all pages at once: rows are counted by ranges and the
ranges before are added, so that no task orders the whole table.

Null keys are on no page. Rows with equal keys stand on one page together, so a page may
hold more rows than asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 100_000


class Scroll:
    """rows and fences of a table written by build()."""

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.rows, self.fences, self.key = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/fences"), key

    def page(self, size: int, after=None, where: Column | None = None) -> DataFrame:
        """The first rows behind the cursor, in order, at least size of them if there are so many, up to the last row of that key."""
        key, ok = F.col(self.key), F.lit(True) if where is None else where
        behind = F.col("last") > F.lit(after) if after is not None else F.lit(True)
        ahead = self.fences.where(behind).orderBy("first")
        begins = F.lit(True) if after is None else key > F.lit(after)
        ranges = 2
        while True:
            read = ahead.limit(ranges).agg(F.max("last").alias("to"), F.count(F.lit(1)).alias("n")).first()
            held = self.rows.where(begins & (key <= F.lit(read["to"])) & ok)
            # Equal keys stand in one range, as ranges are dealt by key.
            if read["n"] < ranges or held.limit(size).count() >= size:
                end = held.orderBy(self.key).limit(size).agg(F.max(self.key)).first()[0]
                return held.where(key <= F.lit(end)).orderBy(self.key)
            ranges *= 2

    def cursors(self, size: int, where: Column | None = None) -> DataFrame:
        """page (from 1), first, last, rows: the pages of the rows that the filter leaves, by size keys each; last is the cursor of the next one."""
        own = self.rows if where is None else self.rows.where(where)
        keys = own.groupBy("range", self.key).agg(F.count(F.lit(1)).alias("n"))
        counted = keys.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy(self.key)))
        totals = keys.groupBy("range").agg(F.count(F.lit(1)).alias("keys"))  # one row for each range
        before = F.coalesce(F.sum("keys").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.join(F.broadcast(totals.select("range", before.alias("before"))), "range")
        page = (F.floor((F.col("before") + F.col("own") - 1) / size) + 1).alias("page")
        return placed.groupBy(page).agg(F.min(self.key).alias("first"), F.max(self.key).alias("last"), F.sum("n").alias("rows"))


def build(rows: DataFrame, key: str, folder: str, range_rows: int = RANGE_ROWS) -> Scroll:
    """Writes rows in ranges of about so many to a folder that all executors share."""
    spark, kept = rows.sparkSession, rows.where(F.col(key).isNotNull()).drop("range")
    n = max(1, -(-kept.count() // range_rows))
    ranged = kept.repartitionByRange(n, key).withColumn("part", F.spark_partition_id()).sortWithinPartitions(key)
    ranged.withColumnRenamed("part", "range").write.parquet(f"{folder}/rows")
    spark.read.parquet(f"{folder}/rows").groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/fences")
    return Scroll(spark, folder, key)
