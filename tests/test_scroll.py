"""Pages by cursor: together the filtered table, each from its own ranges."""

import pytest
from pyspark.sql import functions as F

from doclattice.operators import scroll


def rows():
    return [(i * 3, "a" if i % 5 else "b", i) for i in range(1000)] + [(33, "a", -1), (33, "b", -2), (None, "a", -3)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(), "id long, kind string, range long").withColumnRenamed("range", "other").withColumn("range", F.lit("clash")).repartition(7)
    return scroll.build(df, "id", str(tmp_path_factory.mktemp("scroll") / "t"), range_rows=50)


@pytest.mark.parametrize("where, size", [(None, 90), ("kind = 'b'", 40), ("id = 999", 10), ("false", 5), ("id < 12", 1)])
def test_pages_are_the_table(table, where, size):
    want = sorted((r[0], r[2]) for r in rows() if r[0] is not None)
    if where is not None:
        where = F.expr(where)
        want = sorted((r["id"], r["other"]) for r in table.rows.where(where).collect())
    got, after, pages = [], None, []
    while True:
        page = [(r["id"], r["other"]) for r in table.page(size, after, where).collect()]
        if not page:
            break
        assert page == sorted(page, key=lambda r: r[0]) and (len(page) >= size or len(got) + len(page) == len(want))
        pages.append(page)
        got, after = got + page, page[-1][0]
        if len(got) >= len(want):
            break
    assert sorted(got) == want


def test_cursors_are_the_pages(table):
    keys = sorted({r[0] for r in rows() if r[0] is not None})
    want = {(k // 64 + 1, keys[k], keys[min(k + 63, len(keys) - 1)]) for k in range(0, len(keys), 64)}
    found = table.cursors(64).collect()
    assert {(r.page, r["first"], r["last"]) for r in found} == want and sum(r.rows for r in found) == 1002


def test_a_page_reads_its_ranges_only(table):
    """The rows that the page's filters on keys leave are of few ranges of twenty."""
    page = table.page(60, after=1500)
    read = page.select("range").distinct().count()
    assert read <= 3 and table.fences.count() >= 15
    assert "PushedFilters" in page._jdf.queryExecution().toString() and "GreaterThan(id,1500)" in page._jdf.queryExecution().toString()
