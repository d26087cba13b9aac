"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources, in code point order (null last), share a budget of
``share`` times all sizes by weight; a target stops at ``cap`` times the
source's size and the excess is shared again by weight until none is above.
That fixed point is found in one pass over the sources ordered by the level at
which each reaches its cap.

Offsets: documents of a source stand in a fixed order (by md5 of doc_id, then
size), again and again up to ``cap`` times; the offset of a copy is the sum of
sizes before its middle. Running sums are made in two steps, within buckets of
the md5 and over the buckets' sums, so a source with a third of all rows is
dealt over 4096 tasks.

Positions: a source's weight over training time is a piecewise linear schedule.
Its integral, scaled to the target, is the demand up to a time; a copy at offset
c stands where the demand reaches c, found by inverting the integral (a quadratic
on each piece). The demand ends at the target, so a copy whose offset lies beyond
has no position: it is not taken. What the mix takes of a document is the number
of its positions times its size. The mix is range-partitioned and sorted by
position.

A null text has size 0. Sources of size 0 have target 0. Repeated rows are
documents of their own. Rows with a null doc_id are ordered by the md5 of their
text instead. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.llm.common import count_words, let

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Weight at training times from 0 to 1, by rank of the source modulo their number.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> and rank, weight, target. One narrow row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    stepped = ranked.select(
        "*",
        (share * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    # In order of size by weight: the first source that its share of what is left does not fill sets the rate for all from there on.
    rate = (F.col("budget") - cap * F.col("capped_size")) / F.col("open_weight")
    stepped = stepped.withColumn("rate", rate).withColumn("free", F.col("rate") * F.col("weight") <= cap * F.col("source_size"))
    reached = stepped.withColumn("final", F.min_by("rate", F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank")))).over(everything))
    at_rate = F.col("final") * F.col("weight")
    capped = (cap * F.col("source_size")).cast("double")
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.coalesce(at_rate, capped), capped))
    return reached.select("source", "source_size", "rank", "weight", target.alias("target"))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit(""))))))
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("key"), *more)


def offsets(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """sized() -> and the source's columns, start: the sizes before it in its source's order."""
    more = [c for c in docs.columns if c not in ("doc_id", "source", "size", "key")]
    keyed = docs.withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    named = sources.withColumnRenamed("source", "name")
    return joined.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "source", "size", "source_size", "rank", "target", "key", (F.col("before") + F.col("inner")).alias("start"), *more
    )


def position(share: Column, schedule) -> Column:
    """Where the integral of a piecewise linear schedule reaches this share of its whole."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    out, done = None, 0.0
    for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:]))):
        piece = (t1 - t0) * (w0 + w1) / 2
        done = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:]) if b <= t0)
        slope, need = (w1 - w0) / (t1 - t0), share * area - done
        if slope:
            at = (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))) - w0) / slope
        else:
            at = need / w0 if w0 else need * 0
        value = F.least(F.lit(t0) + at, F.lit(t1))
        out = value if out is None else F.when(share * area < done + piece, value).otherwise(out)
    return out


def with_taken(docs: DataFrame, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """offsets() -> and positions: where each copy that the mix takes stands, times: their number, and taken: the words of that."""

    def place(copy: Column) -> Column:
        offset = F.col("start") + F.col("size") / 2 + (copy - 1) * F.col("source_size")
        chain = lambda share: F.coalesce(*(F.when(F.col("rank") % len(schedules) == k, position(share, s)) for k, s in enumerate(schedules)))
        return F.when((F.col("size") > 0) & (offset <= F.col("target")), let(offset / F.nullif(F.col("target"), F.lit(0.0)), chain))

    positions = F.filter(F.transform(F.sequence(F.lit(1), F.lit(cap)), place), lambda p: p.isNotNull())
    times = F.size("positions").cast("long")
    return docs.withColumn("positions", positions).withColumn("times", times).withColumn("taken", F.col("times") * F.col("size"))


def placed(taken: DataFrame, untaken: bool = False) -> DataFrame:
    """with_taken() -> a row for each time that a document is taken, with copy (from 1) and position.

    untaken: documents that the mix doesn't take have a row with copy 0 and no position.
    """
    explode = F.posexplode_outer if untaken else F.posexplode
    each = taken.select("*", explode("positions").alias("copy", "position"))
    return each.withColumn("copy", F.coalesce(F.col("copy") + 1, F.lit(0))).drop("start", "rank", "times", "positions")


def curriculum(taken: DataFrame, partitions: int | None = None, untaken: bool = False) -> DataFrame:
    """placed(), range-sorted by position; rows without one come first."""
    rows = placed(taken, untaken)
    return sorted_by(rows, "position", "key", "copy", partitions=partitions)


def sorted_by(rows: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """Every document with its source's size and target, positions, times and taken. Texts are read once: their sizes are kept as narrow rows."""
    sizes = sized(docs).checkpoint()
    sources = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    return with_taken(offsets(sizes, sources), schedules, cap)
