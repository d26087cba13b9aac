"""Values at places of sorted groups, by refined histograms.

The value at a place of a group (0 is the least) is found for all groups and places at
once, without sorting a group: rows are counted by BINS bins between the group's least
and greatest value (counts are combined before they are shuffled), the bin that holds the
place becomes the new range, from the least to the greatest value in it, and so on. A
range of at most FEW rows, or of one value, is settled by counts of its values. Ranges
narrow by the number of bins in each pass; after PASSES passes, which values spread over
hundreds of powers of ten alone can need, what is left is settled by counts of its values
as well.

Nulls and values that are no numbers do not count. A group without others has no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.operators.small import sent
from doclattice.sources.files import written

BINS, FEW, PASSES = 1024, 10_000, 8


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]], bins: int = BINS, few: int | None = None) -> DataFrame:
    """by, and for each place the value there. places: the place as a function of the number of rows."""
    few = FEW if few is None else few
    base = rows.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    spans = base.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), place(F.col("m")).cast("long").alias("place")) for n, place in places.items())))
    targets = spans.select(*by, "m", "lo", "hi", asked.alias("t")).select(*by, "t.name", "t.place", "m", "lo", "hi")
    targets = written(targets)

    def same(left: str, right: str, *more: str) -> Column:
        joined = F.lit(True)
        for c in (*by, *more):
            joined = joined & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return joined

    def inside(ranges: DataFrame) -> DataFrame:
        """by, lo, hi, v of the rows in each of the distinct ranges."""
        r = sent(ranges.select(*by, "lo", "hi").distinct())
        held = base.alias("b").join(r.alias("r"), same("b", "r")).where("v >= lo AND v <= hi")
        return held.select(*(F.col(f"r.{c}").alias(c) for c in by), "lo", "hi", "v")

    def placed(counts: DataFrame, order: str, ranges: DataFrame) -> DataFrame:
        """The row of counts (with c and the new range) that holds each target's place, and the place in it."""
        over = Window.partitionBy(*by, "lo", "hi").orderBy(order)
        found = counts.withColumn("reached", F.sum("c").over(over)).alias("c")
        hit = ranges.alias("t").join(found, same("t", "c", "lo", "hi") & (F.col("reached") > F.col("place")) & (F.col("reached") - F.col("c") <= F.col("place")))
        return hit.select(*(F.col(f"t.{c}").alias(c) for c in by), "name", (F.col("place") - F.col("reached") + F.col("c.c")).alias("place"), F.col("c.c").alias("m"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"))

    is_open = (F.col("lo") < F.col("hi")) & (F.col("m") > few)
    for _ in range(PASSES):
        ranges = targets.where(is_open)
        if ranges.isEmpty():
            break
        # Halves, so that a range of the greatest numbers does not overflow.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counted = inside(ranges).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = counted.groupBy(*by, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        targets = written(targets.where(~is_open).unionByName(placed(counts, "bin", ranges)))  # narrow rows; the next pass reads them, not what made them
    left = targets.where("lo < hi")
    values = inside(left).groupBy(*by, "lo", "hi", "v").agg(F.count(F.lit(1)).alias("c")).withColumns({"new_lo": F.col("v"), "new_hi": F.col("v")})
    settled = targets.where("lo = hi").unionByName(placed(values, "v", left))
    return settled.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("lo"))).alias(n) for n in places))
