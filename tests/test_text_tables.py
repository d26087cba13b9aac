"""Tables in text against a plain sweep."""

import re

import pytest

from pyspark.sql import functions as F

from doclattice.functions.figures import matches_with_places
from doclattice.operators import scan, text_tables
from doclattice.plans import registry
from doclattice.plans.structure_queries import padded_lines

PART = re.compile(r"\S+(?: \S+)*")


def plain(rows):
    """{(doc, first line): matrix} before trimming and tests, of lines (doc, line_no, line)."""
    out, block = {}, []

    def close():
        if not block:
            return
        spans, columns = sorted({m.span() for _, _, ms in block for m in ms}), []
        for a, z in spans:
            if columns and a <= columns[-1][1]:
                columns[-1][1] = max(columns[-1][1], z)
            else:
                columns.append([a, z])
        held = block[: text_tables.MOST_ROWS]
        matrix = []
        for _, _, ms in held:
            row = [""] * len(columns)
            for m in ms:
                k = next(i for i, (a, z) in enumerate(columns) if a <= m.start() < z)
                row[k] = f"{row[k]} {m[0]}".strip()
            matrix.append(row)
        out[held[0][0], held[0][1]] = matrix
        block.clear()

    for doc, no, line in sorted(rows, key=lambda r: (r[0], r[1])):
        ms = list(PART.finditer(line or ""))
        if len(ms) < 2 or (block and block[-1][0] != doc):
            close()
        if len(ms) >= 2:
            block.append((doc, no, ms))
    close()
    return out


def valid(m):
    sizes, cells = [len(r) for r in m], [c for r in m for c in r if c.strip()]
    return len(m) >= 2 and sum(sizes) >= 2 * len(m) and len(cells) >= 0.25 * sum(sizes) and len(cells) >= 4 and sum(map(len, cells)) <= 150 * len(cells)


LINES = [
    "Title of it", "Name      Size   Note", "pump a    12     in use", "valve     3", "", "One   two", "plain text here", "x  y", "long first cell  b", "a  longer second", None,
    "only  row", "text", "left   right   far", "left           far", "  lead   right  far end",
]


@pytest.mark.parametrize("width", [None, 3])
def test_columns_by_gaps(spark, monkeypatch, width):
    if width:
        monkeypatch.setattr(scan, "BLOCK", width)
    rows = [(d, i, x) for d in (1, 2) for i, x in enumerate(LINES)]
    want = {k: m for k, m in plain(rows).items() if valid(m)}
    got = {(r.doc_id, r.first_line): r.matrix for r in text_tables.text_tables(spark.createDataFrame(rows, "doc_id long, line_no int, line string"), ["doc_id"]).collect()}
    trim = lambda m: [r for r in m if any(c.strip() for c in r)]
    assert {k: [[c for c in r] for r in m] for k, m in got.items()} == {k: trim(m) for k, m in want.items()} and got[1, 1] == [["Name", "Size", "Note"], ["pump a", "12", "in use"], ["valve", "3", ""]]


def test_bounds(spark):
    rows = [(1, i, f"a{i:03}  b") for i in range(700)] + [(2, i, "  ".join(f"c{k:02}" for k in range(80))) for i in range(3)] + [(3, 0, "a  b")]
    got = {r.doc_id: (r.rows, r.cols) for r in text_tables.text_tables(spark.createDataFrame(rows, "doc_id long, line_no int, line string"), ["doc_id"]).collect()}
    assert got == {1: (500, 2), 2: (3, 50)}
    assert text_tables.text_tables(spark.createDataFrame([], "doc_id long, line_no int, line string"), ["doc_id"]).count() == 0


def test_query_finds_the_plain_tables(spark, sf_dir):
    rows = [tuple(r) for r in padded_lines(spark, sf_dir).collect()]
    want = {k: len(m) for k, m in plain(rows).items() if valid(m)}
    got = {(r.doc_id, r.first_line): r.rows for r in registry.queries()["t7_t5_p17_t3_page_tables"](spark, sf_dir).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) > 20 and all(want[k] == n for k, n in got.items())


def test_a_part_of_very_many_words(spark):
    long = " ".join(["word"] * 200_000)
    rows = spark.createDataFrame([(1, 0, long + "   b"), (1, 1, "c   d")], "doc_id long, line_no int, line string").withColumn("parts", matches_with_places(F.col("line"), F.lit(text_tables.PART)))
    got = {r.line_no: [(p.match, p.start) for p in r.parts] for r in rows.collect()}
    assert got == {0: [(long, 0), ("b", len(long) + 3)], 1: [("c", 0), ("d", 4)]}
