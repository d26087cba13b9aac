"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line of a host, the pages of the host that
hold it, divided by all pages of the host, make its ratio; a line whose ratio
exceeds the limit is boilerplate and is dropped from every page of that host. A
line that fewer than LEAST_PAGES pages hold is no line in common, whatever its
ratio (on a host of fewer than 1 / RATIO pages each line would exceed it, and
the host would lose all of its texts). What is left keeps its order.

A host's boilerplate is a small set: pages with L lines on average have at most
L / limit lines above the limit. It is gathered as one array of 128-bit line
hashes for each host, from counts that are aggregated before the shuffle. The
arrays reach the pages by a broadcast if their measured size is within
BROADCAST_HASHES, else by a join salted by SALTS, so that a host with a third
of all pages is dealt over many tasks.

Lines are parts between line feeds; lines without a character other than white
space are neither counted nor dropped. A null text stays null and a page with
it counts in its host's total. Null hosts form one host. Repeated rows are
pages of their own; with copies=False, rows of a host with one text count as
one page, in the lines' counts and in the total, so that copies of a document
do not make its lines boilerplate. Empty tables give no rows. Extra columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.common import WORD, let

RATIO, SALTS = 0.05, 32
#: Pages that a line of boilerplate is on at least; 1 leaves the ratio alone to decide.
LEAST_PAGES = 2
#: Most line hashes in all that are broadcast (16 bytes each).
BROADCAST_HASHES = 250_000


def line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), line).alias("b"))


def host_lines(pages: DataFrame, ratio: float, text: str, host: str, copies: bool = True, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, lines: the hashes of each host's boilerplate."""
    held = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))), line_hash))
    rows = pages.select(F.col(host).alias("host"), F.md5(text).alias("digest"), held.alias("held"))
    if not copies:
        rows = rows.groupBy("host", "digest").agg(F.first("held").alias("held"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        rows.select("host", F.explode("held").alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_pages)
    )
    t = totals.withColumnRenamed("host", "of")
    above = counts.join(t, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return above.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(
    pages: DataFrame, ratio: float = RATIO, text: str = "text", host: str = "source", salts: int = SALTS, broadcast_hashes: int = BROADCAST_HASHES,
    copies: bool = True, least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """pages with the text cleaned, and line_count and dropped_count (long) appended."""
    found = host_lines(pages, ratio, text, host, copies, least_pages).checkpoint()
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)), F.count(F.lit(1))).first()
    found = found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    if size[0] + size[1] <= broadcast_hashes:
        joined = pages.join(F.broadcast(found), F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    else:
        salted = found.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # By what a row holds, so that it goes to the same task again after a lost executor.
        own = [c for c, kind in pages.dtypes if "map<" not in kind]
        dealt = pages.withColumn("__salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
        joined = dealt.join(salted, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__salt") == F.col("__of")), "left").drop("__host", "__salt", "__of")
    lines = F.split(text, "\n")
    kept = F.when(F.col("__lines").isNull(), F.struct(F.col(text).alias("text"), F.size(lines).alias("n"), F.size(lines).alias("k"))).otherwise(
        let(
            lines,
            lambda all_lines: let(
                F.filter(all_lines, lambda x: ~F.array_contains(F.col("__lines"), line_hash(x))),
                lambda left: F.struct(F.array_join(left, "\n").alias("text"), F.size(all_lines).alias("n"), F.size(left).alias("k")),
            ),
        )
    )
    return joined.withColumn("__kept", kept).withColumns(
        {
            text: F.when(F.col(text).isNotNull(), F.col("__kept.text")),
            "line_count": F.greatest(F.coalesce("__kept.n", F.lit(0)), F.lit(0)).cast("long"),
            "dropped_count": F.coalesce(F.col("__kept.n") - F.col("__kept.k"), F.lit(0)).cast("long"),
        }
    ).drop("__kept", "__lines")
