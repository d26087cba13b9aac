"""Every reference query against its SQL, and that it is not empty."""

import math

import duckdb
import pytest

from doclattice.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(v)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
    assert got, "no rows"
    sql = registry.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    else:
        assert name in {"t1_t2_sentence_chunks", "t3_t5_table_chunks", "t4_s9_s10_csv_chunks", "t6_keep_first_tables", "t7_t5_p17_t3_page_tables", "e3_components", "st1_rate_limit"}


def test_entry(spark, sf_dir):
    assert registry.entry(spark, sf_dir).count() > 0
