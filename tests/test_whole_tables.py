"""Tables in text with more rows and columns than the bounds, whole and as bounded."""

import pyarrow as pa
import pyarrow.parquet as pq

from doclattice.operators import text_tables
from doclattice.plans import registry

KEYS = "doc_id long, line_no int, line string"


def found(spark, rows, **bounds):
    return {r.doc_id: r for r in text_tables.text_tables(spark.createDataFrame(rows, KEYS), ["doc_id"], **bounds).collect()}


def test_whole_tables(spark):
    wide = [f"c{k:03}" for k in range(300)]
    rows = [(1, i, f"a{i:04}  b") for i in range(1500)] + [(2, i, "  ".join(wide)) for i in range(3)]
    got = found(spark, rows, most_rows=None, most_columns=None)
    assert {d: (r.rows, r.cols) for d, r in got.items()} == {1: (1500, 2), 2: (3, 300)}
    assert got[1].matrix == [[f"a{i:04}", "b"] for i in range(1500)] and got[2].matrix == [wide] * 3


def test_bounds_come_after_the_test(spark):
    # Rows behind the 500th join all columns (1), have long cells (2), or make a block too wide for what is filled (3).
    rows = [(1, i, "a  b  c") for i in range(600)] + [(1, 600, "axxb  c"), (1, 601, "a  bxxc")]
    rows += [(2, i, "a  b") for i in range(500)] + [(2, 500 + i, "a  " + "x" * 400_000) for i in range(3)]
    rows += [(3, i, "a  b") for i in range(600)] + [(3, 600, "a  b" + "  c" * 40)]
    assert found(spark, rows) == {}


def test_query_keeps_all_columns(spark, tmp_path):
    text = "\n".join("  ".join(f"c{k:02}" for k in range(80)) for _ in range(7))
    pq.write_table(pa.table({"doc_id": [1], "source": ["a"], "text": [text]}), tmp_path / "documents.parquet")
    # Lines 1 and 6 stay as they are (0 is a heading, 2 to 5 are three words in columns), and so the table has all their columns but those that words join.
    got = registry.queries()["t7_t5_p17_t3_page_tables"](spark, str(tmp_path)).collect()
    assert [(r.first_line, r.rows) for r in got] == [(1, 6)] and got[0].cols > 50
