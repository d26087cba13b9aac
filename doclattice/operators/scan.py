"""Running values over rows in order, for groups of any size.

A window over a whole group is one task, however long the group. Here rows are
dealt into blocks of consecutive numbers of their order: each block is scanned by a
window of its own, each block's total is taken by an aggregation that is combined
before it is shuffled, and what the blocks before a block add up to (its carry) is
joined back. Carries are one narrow row for each block after the first of a group,
so a group of L rows is L / BLOCK of them.

Order is a column of whole numbers (lines, pages, sections, microseconds); width is
how many of them are a block. Rows with equal numbers are in one block. Nulls of ``by``
form a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.operators.small import sent

#: Numbers in a block.
BLOCK = 4096


def blocks(rows: DataFrame, order: str, width: int | None) -> DataFrame:
    return rows.withColumn("__block", F.floor(F.col(order) / (width or BLOCK)))


def with_carry(rows: DataFrame, totals: DataFrame, by: list[str], before: Column, new: str) -> DataFrame:
    """rows with what the blocks before theirs add up to. totals: by, __block and what ``before`` reads."""
    named = totals.select(*(F.col(c).alias(f"__of_{c}") for c in by), F.col("__block").alias("__of"), before.alias(new)).where(F.col(new).isNotNull())
    carries = sent(named.persist(StorageLevel.MEMORY_AND_DISK))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.col("__block") == F.col("__of"))
    return rows.join(carries, same, "left").drop(*(f"__of_{c}" for c in by), "__of")


def earlier(by: list[str]):
    return Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def inside(by: list[str], order: list[str]):
    return Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_count(rows: DataFrame, flag: Column, new: str, by: list[str], order: str, width: int | None = None, peers: bool = False) -> DataFrame:
    """rows with the number of rows of their group up to and with them for which the flag holds. peers: and with all rows of their number, as SQL counts without a frame."""
    dealt = blocks(rows.withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("long")), order, width)
    totals = dealt.groupBy(*by, "__block").agg(F.sum("__flag").alias("__n"))
    within = inside(by, [order]).rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else inside(by, [order])
    counted = dealt.withColumn("__own", F.sum("__flag").over(within))
    before = F.nullif(F.sum("__n").over(earlier(by)), F.lit(0))
    found = with_carry(counted, totals, by, before, "__before")
    return found.withColumn(new, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__flag", "__block", "__own", "__before")


def fill_forward(rows: DataFrame, value: str, new: str, by: list[str], order: list[str], width: int | None = None) -> DataFrame:
    """rows with the last value that is not null up to and with them. order: the first column is a whole number, by which rows are dealt."""
    dealt = blocks(rows, order[0], width)
    held = F.col(value).isNotNull()
    totals = dealt.where(held).groupBy(*by, "__block").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    # Blocks without a value take the carry of others, so they have a row too.
    every = dealt.select(*by, "__block").distinct().withColumn("__last", F.lit(None).cast(rows.schema[value].dataType))
    both = totals.unionByName(every).groupBy(*by, "__block").agg(F.first("__last", ignorenulls=True).alias("__last"))
    filled = dealt.withColumn("__own", F.last(value, ignorenulls=True).over(inside(by, order)))
    found = with_carry(filled, both, by, F.last("__last", ignorenulls=True).over(earlier(by)), "__before")
    return found.withColumn(new, F.coalesce("__own", "__before")).drop("__block", "__own", "__before")
