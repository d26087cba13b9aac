"""Document structure: sections of lines, chapters, pages and tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions import text as T
from doclattice.operators import scan


def merge_small(sections: DataFrame, order: str, least: int = 200) -> DataFrame:
    """Sections shorter than ``least`` are joined to what follows, up to and with the next long one.

    Islands are counted by the long sections strictly before; empty sections are
    skipped. Title and number come from the last member, the page from the first.
    """
    stripped = sections.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).where("content <> ''")
    long = F.length("content") >= least
    counted = scan.running_count(stripped, long, "reached", ["doc_id"], order)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "content"))), lambda x: x["content"])
    return (
        counted.withColumn("island", F.col("reached") - long.cast("long"))
        .groupBy("doc_id", "island")
        .agg(
            F.max_by("title", order).alias("title"),
            F.max_by("number", order).alias("number"),
            F.min_by("page_start", order).alias("page_start"),
            F.count(F.lit(1)).alias("original_count"),
            F.array_join(parts, "\n\n").alias("content"),
        )
    )


def runs(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: by, first, last, length."""
    over = Window.partitionBy(*by).orderBy(number)
    keyed = rows.select(*by, number).distinct().withColumn("k", F.col(number) - F.row_number().over(over))
    return keyed.groupBy(*by, "k").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("length")).drop("k")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row at or before it (by union and fill, no range join)."""
    cols = [c for c in left.columns if c not in (*by, at)]
    both = left.select(*by, at, *cols, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(
        right.select(*by, at, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), value, F.lit(0).alias("side"))
    )
    return scan.fill_forward(both, value, "__filled", by, [at, "side"]).where("side = 1").withColumn(value, F.col("__filled")).drop("side", "__filled")


def toc_entries(rows: DataFrame) -> DataFrame:
    """Entries of a table of contents from its lines: line_no, title, level, page. The first pattern that fits a line decides.

    What the patterns find is taken once for each line, as columns.
    """
    part = lambda pattern, g: F.regexp_extract("line", pattern, g)
    dotted, spaced = r"^(.+?)\s*[.…·\-_]{3,}\s*([0-9]+)\s*$", r"^([0-9]+(?:\.[0-9]+)*)\s+(.+?)\s{2,}([0-9]+)\s*$"
    plain, bare = r"^(.+?)\s{2,}([0-9]+)\s*$", r"^([0-9]+(?:\.[0-9]+)*)\s+([A-Z\s&]+)$"
    found = rows.select("doc_id", "line_no", "page", T.strip(F.col("line")).alias("line")).where("length(line) >= 5").select(
        "doc_id", "line_no", "page",
        T.strip(part(dotted, 1)).alias("d1"), part(dotted, 2).alias("d2"),
        part(spaced, 1).alias("s1"), T.strip(part(spaced, 2)).alias("s2"), part(spaced, 3).alias("s3"),
        part(plain, 1).alias("p1"), part(plain, 2).alias("p2"),
        part(bare, 1).alias("b1"), T.strip(part(bare, 2)).alias("b2"),
    )
    named = found.withColumn("p1", T.strip(F.col("p1"))).withColumn("long", F.length("p1") > 5)
    depth = lambda n: F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) + 1
    p1, b2 = F.col("p1"), F.col("b2")
    # Of a line with two blanks before a number at its end: titles that are no codes or captions and do not begin with a bare number.
    titled = F.col("long") & ~F.rlike(p1, F.lit(r"^[A-Z0-9]{2,}-[0-9]+\s|\([0-9]+\)\s*$|^[0-9](?![0-9]*\.)"))
    kind = F.when(F.col("d2") != "", 1).when(F.col("s3") != "", 2).when((F.col("p2") != "") & titled, 3).when((F.col("b1") != "") & (F.length(b2) >= 10) & (F.size(T.words(b2)) >= 2), 4)
    kinds = named.withColumn("kind", kind).where("kind IS NOT NULL")
    of = lambda a, b, c, d: F.when(F.col("kind") == 1, a).when(F.col("kind") == 2, b).when(F.col("kind") == 3, c).otherwise(d)
    titles = kinds.withColumn("title", of(F.col("d1"), F.concat_ws(" ", "s1", "s2"), p1, F.concat_ws(" ", "b1", "b2")))
    return titles.select(
        "doc_id", "line_no", "title",
        F.when(F.col("kind").isin(1, 3), T.toc_level(F.col("title"))).otherwise(F.when(F.col("kind") == 2, depth(F.col("s1"))).otherwise(depth(F.col("b1")))).cast("int").alias("level"),
        of(F.col("d2"), F.col("s3"), F.col("p2"), (F.col("page") + 1).cast("string")).cast("int").alias("toc_page"),
    )
