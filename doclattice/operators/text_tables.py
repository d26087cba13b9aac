"""Tables in the text of pages, by columns that consecutive lines have in common.

A line of two or more parts, parted by two spaces or more, is a table's row; rows that
follow each other are a block. A sweep over the character intervals of a block's parts
joins those that overlap: what is left between them are the gaps of the columns, at which
the rows are split. Blocks are numbered by blocks of lines (scan), so a long document is
dealt over many tasks; the sweep reads the distinct intervals of a block only.

A block is trimmed and tested as a matrix of all its rows and columns (as by
chunking.trim_matrix, valid_matrix), by what its rows add up to, before they are padded: so
only tables are, of whose cells a quarter is filled at least. Rows are texts with a line feed
between columns until then. At most most_rows rows and most_columns columns of a table are
given, or all. Null lines are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions.figures import matches_with_places
from doclattice.operators import scan

# The cells that make a table, and the bounds of what is given of it unless others are asked for.
LEAST_CELLS, MOST_ROWS, MOST_COLUMNS = 4, 500, 50
# Possessive, so that a part of very many words is matched by a loop and not by recursion.
PART = r"\S++(?: \S++)*+"


def text_tables(lines: DataFrame, by: list[str], order: str = "line_no", text: str = "line", most_rows: int | None = MOST_ROWS, most_columns: int | None = MOST_COLUMNS) -> DataFrame:
    """by, first_line, rows, cols, matrix (array<array<string>>) of the tables in lines; by has no nulls. most_rows, most_columns: None for whole tables."""
    parts = lines.select(*by, order, matches_with_places(F.col(text), F.lit(PART)).alias("parts"))
    is_row = F.coalesce(F.size("parts") >= 2, F.lit(False))
    counted = scan.running_count(parts, ~is_row, "block", by, order).where(is_row)
    of = [*by, "block"]
    each = counted.select(*of, order, F.explode("parts").alias("p")).select(*of, order, F.col("p.start").alias("start"), (F.col("p.start") + F.length("p.match")).alias("end"), F.col("p.match").alias("cell"))
    # The sweep: a part that begins behind all that began before it, with a place free between, begins a column.
    sweep = Window.partitionBy(*of).orderBy("start")
    reached = F.max("end").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    spans = each.groupBy(*of, "start").agg(F.max("end").alias("end")).withColumn("new", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
    columns = spans.select(*of, "start", F.sum("new").over(sweep).cast("int").alias("column"))
    cells = each.join(columns, [*of, "start"]).groupBy(*of, order).agg(F.sort_array(F.collect_list(F.struct("column", "start", "cell"))).alias("cells"))
    # Before a part: a blank behind another one of its column, else a line feed (of which parts have none) for each column from the one before.
    before = lambda c, i: F.coalesce(F.when(i > 0, F.get("cells", i - 1)["column"]), F.lit(0))
    lead = lambda c, i: F.when(c["column"] == before(c, i), F.lit(" ")).otherwise(F.repeat(F.lit("\n"), c["column"] - F.greatest(before(c, i), F.lit(1))))
    rows = cells.select(*of, order, F.array_join(F.transform("cells", lambda c, i: F.concat(lead(c, i), c["cell"])), "").alias("row"), F.size(F.array_distinct(F.col("cells.column"))).alias("filled"), F.element_at("cells", -1)["column"].alias("wide"))
    chars = F.length(F.translate("row", "\n", ""))
    blocks = rows.groupBy(*of).agg(
        F.min(order).alias("first_line"), F.sort_array(F.collect_list(F.struct(order, "row", "wide"))).alias("held"), F.count(F.lit(1)).alias("n"), F.max("wide").alias("width"), F.sum("filled").alias("filled"), F.sum(chars).alias("chars")
    )
    # What chunking.valid_matrix asks of rows of one width.
    valid = blocks.where("n >= 2 AND width >= 2 AND filled >= 0.25 * n * width AND filled >= 4 AND chars <= 150 * filled")
    least = lambda value, most: (F.col(value) if most is None else F.least(F.col(value), F.lit(most))).cast("int")
    given = valid.withColumns({"rows": least("n", most_rows), "cols": least("width", most_columns)}).where(F.col("rows") * F.col("cols") >= LEAST_CELLS)
    padded = lambda r: F.slice(F.split(F.concat(r["row"], F.repeat(F.lit("\n"), F.col("width") - r["wide"])), "\n"), F.lit(1), F.col("cols"))
    # A generated column, which Spark does not put into what reads it.
    return given.select(*by, "first_line", "rows", "cols", F.explode(F.array(F.transform(F.slice("held", F.lit(1), F.col("rows")), padded))).alias("matrix"))
