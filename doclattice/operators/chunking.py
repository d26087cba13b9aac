"""Chunking of texts and tables."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

CHUNK, OVERLAP, SEARCH = 1600, 400, 200
SENTENCE_END = re.compile(r"[.!?\n]")


def cuts(text: str, size: int = CHUNK, overlap: int = OVERLAP, search: int = SEARCH):
    """[start, end) of overlapping chunks. A chunk ends after the sentence end nearest to its size, the first of two equally near ones, if one is within reach."""
    after = [m.end() for m in SENTENCE_END.finditer(text)]
    n, a = len(text), 0
    while a + size < n:
        aim = a + size
        k = bisect_left(after, aim)  # after[k - 1] < aim <= after[k]
        z = min((e for e in after[max(k - 1, 0) : k + 1] if aim - search < e <= aim + search), key=lambda e: abs(e - aim), default=aim)
        yield a, z
        if z == n:
            return
        a = z - overlap
    if n:
        yield a, n


def chunk_spans(text: str, size: int = CHUNK, overlap: int = OVERLAP, search: int = SEARCH) -> list[tuple[int, int]]:
    """cuts() without blank chunks."""
    return [(a, z) for a, z in cuts(text, size, overlap, search) if not text[a:z].isspace()]


SPANS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("index", "char_start", "char_end", "from", "to")]))


def stripped(text: str, a: int, z: int) -> tuple[int, int]:
    """[a, z) of a text without white space at both ends."""
    part = text[a:z]
    return z - len(part.lstrip()), a + len(part.rstrip())


@F.udf(returnType=SPANS, useArrow=False)
def text_spans(text):
    """Places of the chunks of a text, and of what is left of each without white space at both ends. Each cut depends on the one before, so a text is read in one go."""
    t = text or ""
    return [(i, a, z, *stripped(t, a, z)) for i, (a, z) in enumerate(chunk_spans(t))]


def chunk_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each chunk: the columns but the text, and index, char_start, char_end, text. Only places come from Python, text by text; texts are cut by built-in functions."""
    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, F.col(text).alias("__text"), F.explode(text_spans(F.col(text))).alias("c"))
    return cut.select(*rest, "c.index", "c.char_start", "c.char_end", F.substring("__text", F.col("c.from") + 1, F.col("c.to") - F.col("c.from")).alias("text"))


def strided_chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Chunks at a fixed stride, without regard to sentences, by built-in functions."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / float(step)), F.lit(1)).cast("int")
    rest = [c for c in docs.columns if c != text]
    spread = docs.select("*", F.posexplode(F.sequence(F.lit(0), (n - 1) * step, F.lit(step))).alias("index", "char_start"))
    return spread.select(*rest, "index", "char_start", F.substring(text, F.col("char_start") + 1, F.lit(size)).alias("chunk"))


def chunk_page(first: Column, last: Column, start: Column, end: Column, length: Column) -> Column:
    """The page of a chunk's middle, by its share of the text, from 1."""
    pages = last - first + 1
    return F.least(F.greatest(first + F.floor((start + end) / 2 / length * pages), first), last).cast("int") + 1


def packed(rows: Column, most: int, cost, empty: str, joiner: str = "\n") -> Column:
    """array<string> joined greedily into fewer ones while the sum of costs stays within ``most``; a row that costs more stands alone. Without rows: ``empty``."""
    state = lambda out, part, used: F.struct(out.alias("out"), part.alias("part"), used.cast("long").alias("used"))
    start = state(F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(0))

    def add(s: Column, r: Column) -> Column:
        full = s["part"].isNotNull() & (s["used"] + cost(r) > most)
        longer = F.when(s["part"].isNull(), r).otherwise(F.concat(s["part"], F.lit(joiner), r))
        return F.when(full, state(F.concat(s["out"], F.array(s["part"])), r, cost(r))).otherwise(state(s["out"], longer, s["used"] + cost(r)))

    return F.aggregate(rows, start, add, lambda s: F.concat(s["out"], F.array(F.coalesce(s["part"], F.lit(empty)))))


def bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def is_blank(c: Column) -> Column:
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(r"^\s*$"))


def filled_rows(m: Column) -> Column:
    return F.filter(m, lambda r: ~F.forall(r, is_blank))


def filled_width(m: Column) -> Column:
    """Up to the last column that isn't blank in all rows."""
    last = lambda r: F.coalesce(F.array_max(F.transform(r, lambda c, i: F.when(~is_blank(c), i + 1))), F.lit(0))
    return F.coalesce(F.array_max(F.transform(m, last)), F.lit(0))


def trim_matrix(m: Column) -> Column:
    """Without blank rows, padded to one width, without blank columns at the end."""
    rows = filled_rows(m)
    width = filled_width(rows)
    return F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.get(r, i - 1), F.lit(""))))


def table_chunks(m: Column, tokens: int = 4000) -> Column:
    """Texts of a matrix, trimmed as by trim_matrix: cells joined by bars, rows packed to so many tokens of four characters; a longer row is cut.

    Padding is written as text at once, so that one long row does not make cells for all others.
    """
    bar = " | "
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")

    def line(r: Column, width: Column) -> Column:
        pad = F.least(F.greatest(width - F.size(r), F.lit(0)), F.lit(tokens * 4))
        return F.left(F.concat(F.array_join(F.transform(F.slice(r, F.lit(1), F.greatest(width, F.lit(1))), cell), bar), F.repeat(F.lit(bar), pad)), F.lit(tokens * 4))

    lines = lambda rows: bound(filled_width(rows), lambda width: F.transform(rows, lambda r: line(r, width)))
    return packed(bound(filled_rows(m), lines), tokens, lambda r: F.floor(F.length(r) / 4), "")


def record_chunks(csv: Column, most: int = 500) -> Column:
    """Rows of a comma-separated text as "header: value" pairs without blanks, packed to so many characters, a line feed for each row included."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.split(F.coalesce(csv, F.lit("")), "\n"), lambda x: ~is_blank(x))
    cells = F.transform(lines, lambda x: F.transform(F.split(x, ","), strip))

    def texts(all_rows: Column) -> Column:
        header = F.get(all_rows, F.lit(0))
        pair = lambda r: F.transform(F.slice(r, F.lit(1), F.size(header)), lambda v, i: F.when(v != "", F.concat(F.get(header, i), F.lit(": "), v)))
        rows = F.transform(F.slice(all_rows, 2, 2**30), lambda r: F.array_join(pair(r), ", "))
        chunks = packed(F.filter(rows, lambda t: t != ""), most, lambda t: F.length(t) + 1, "[Empty table]")
        return (
            F.when(F.size(all_rows) == 0, F.array(F.lit("[Empty table]")))
            .when(F.size(all_rows) == 1, F.array(F.concat(F.lit("Table columns: "), F.array_join(header, ", "))))
            .otherwise(chunks)
        )

    return bound(cells, texts)


def valid_matrix(m: Column) -> Column:
    """Two rows or more, columns that differ by 40 % at most, two on average, a quarter of cells filled and four at least, 150 characters a cell at most."""
    sizes = F.transform(m, F.size)
    cells = F.filter(F.flatten(m), lambda c: F.trim(c) != "")
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    chars = F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c))
    return (
        (F.size(m) >= 2)
        & (F.array_max(sizes) - F.array_min(sizes) <= 0.4 * F.array_max(sizes))
        & (total >= 2 * F.size(m))
        & (F.size(cells) >= 0.25 * total)
        & (F.size(cells) >= 4)
        & (chars <= 150 * F.size(cells))
    )
