"""Running values by blocks against plain loops, and how the work is dealt."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from doclattice.operators import scan, structure
from doclattice.sources import tables
from doclattice.streaming import rate_limit

SCHEMA = "g int, at long, value string, __n string"


def rows_of(n, seed=1):
    """A third of all rows in one group, a group without a key, values that are mostly null, gaps in the order."""
    rng, out, place = random.Random(seed), [], {}
    for _ in range(n):
        g = 0 if rng.random() < 0.34 else rng.choice([1, 2, 3, None])
        place[g] = place.get(g, 0) + rng.choice([1, 1, 1, 2, 50])
        out.append((g, place[g], rng.choice("abc") if rng.random() < 0.05 else None, "x"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
def test_equals_plain_loops(spark, width):
    rows = rows_of(700)
    df = spark.createDataFrame(rows, SCHEMA)
    count, last, want = {}, {}, set()
    for g, at, v, _ in sorted(rows, key=lambda r: r[1]):
        count[g] = count.get(g, 0) + (v == "a")
        last[g] = v or last.get(g)
        want.add((g, at, count[g], last[g]))
    counted = scan.running_count(df, F.col("value") == "a", "n", ["g"], "at", width)
    filled = scan.fill_forward(counted, "value", "last", ["g"], ["at"], width)
    assert {(r.g, r["at"], r.n, r["last"]) for r in filled.collect()} == want and len(want) == len(rows)
    assert filled.columns == ["g", "at", "value", "__n", "n", "last"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scan.running_count(df, F.lit(True), "n", ["g"], "at").count() == scan.fill_forward(df, "value", "v", ["g"], ["at"]).count() == 0


def rows_by_task(spark, make):
    """Rows of each task that has some, with many partitions that are not joined."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = make()
        whole = F.max(F.xxhash64(*rows.columns)).alias("whole")  # so that no column is left out
        return sorted(r.n for r in rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), whole).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_long_document_is_many_tasks(spark, monkeypatch):
    """A document with a third of all lines: no task has more than three times the middle one's."""
    monkeypatch.setattr(scan, "BLOCK", 512)
    rows = [(0, "s", i, 1, f"line {i}") for i in range(120_000)] + [(d, "s", i, 1, "x") for d in range(1, 2401) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, line_no int, page int, line string").repartition(8)
    sizes = rows_by_task(spark, lambda: tables.numbered_sections(df))
    assert sum(sizes) == len(rows) and len(sizes) == 40 and sizes[-1] <= 3 * sizes[20]


def test_as_of_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 3)
    left = spark.createDataFrame([(1, p) for p in range(0, 60, 2)] + [(2, 5)], "d int, page int")
    right = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (1, 41, "c"), (2, 9, "d")], "d int, page int, s string")
    got = {(r.d, r.page): r.s for r in structure.as_of(left, right, ["d"], "page", "s").collect()}
    assert got == {(1, p): None if p < 7 else "b" if p < 41 else "c" for p in range(0, 60, 2)} | {(2, 5): None}


def requests(n, seed):
    rng, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0.0, 0.5, 1.0, 3.0, 9.99, 10.0, 10.01, 45.0])
        out.append(("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", at, i))
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_bursts_change_no_decision(spark, most):
    rows = requests(800, most)
    logs, want = {}, set()
    for k, at, i in rows:
        want.add((i, *rate_limit.decide(logs.setdefault(k, deque()), at, most, 10.0)))
    got = rate_limit.replay(spark.createDataFrame(rows, "key string, at double, event_id long").repartition(5), most, 10.0).collect()
    assert {(r.event_id, r.allowed, r.retry_after) for r in got} == want and len(got) == len(rows)


def test_a_hot_key_with_gaps_is_many_tasks(spark):
    """One key with a third of all requests, in bursts: no task has more than three times the middle one's."""
    rows = [("hot", 1000.0 * (i // 100) + (i % 100) / 20, i) for i in range(20_000)] + [(f"k{i % 300}", float(i), 100_000 + i) for i in range(40_000)]
    df = spark.createDataFrame(rows, "key string, at double, event_id long").repartition(8)
    sizes = rows_by_task(spark, lambda: rate_limit.replay(df, 3, 10.0))
    assert sum(sizes) == len(rows) and sizes[-1] <= 3 * sizes[len(sizes) // 2]
