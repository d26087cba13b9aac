"""Hard negatives against brute force, with blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.llm import hard_negatives
from doclattice.llm.common import prepare

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType()), T.StructField("id", T.LongType())]
)


def rows_of(n, seed, labels=4, dim=6):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        # A third of the rows have one label; coarse components make many ties.
        label = 0 if r.random() < 0.34 else r.randrange(labels)
        rows.append((k, [r.randrange(-4, 9) / 16 for _ in range(dim)], label, "x", 7))
    return rows


def brute(rows, every, most_p=5, most_n=10):
    import math

    ok = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [max(-(1 << 27), min(1 << 27, math.floor(x * 256))) for x in v])
        ok[i] = min(ok.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(ok[a][1], ok[b][1]))
    out = []
    for a in ok:
        if a % every:
            continue
        ranked = sorted((-score(a, b), b) for b in ok if b != a)
        positives = [(b, -s) for s, b in ranked if ok[b][0] == ok[a][0]][:most_p]
        for p, ps in positives:
            found = [(b, -s) for s, b in ranked if ok[b][0] != ok[a][0] and 30 * ps <= -100 * s <= 90 * ps][:most_n]
            out += [(a, p, k, b, ps, s) for k, (b, s) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, every=3, **blocks):
    prepare(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, **blocks).collect())


@pytest.mark.parametrize("blocks", [{}, {"block_anchors": 7, "block_rows": 11, "chunk": 4}, {"block_anchors": 1, "block_rows": 5, "chunk": 1}])
def test_equals_brute_force(spark, blocks):
    rows = rows_of(120, 5)
    want = brute(rows, 3)
    assert want and found(spark, rows, **blocks) == want


def test_odd_rows(spark):
    """Nulls anywhere, components that are no numbers, rows of one id, other lengths, extra columns that clash."""
    rows = rows_of(40, 8)
    rows += [rows[4], rows[4], (4, rows[5][1], 3, "y", 1), (None, rows[0][1], 0, None, None), (50, None, 0, "", 2), (51, rows[0][1], None, "", 3), (52, [0.5, None], 1, "", 4)]
    rows += [(53, [float("nan")] * 6, 1, "", 5), (54, [float("inf")] * 6, 1, "", 5), (57, [0.5, 0.25], 0, "", 6), (60, [], 0, "", 6), (63, [0.25] * 9, 1, "", 6), (66, [3e38] * 2, 1, "", 6)]
    want = brute(rows, 3)
    assert want and found(spark, rows, block_anchors=5, block_rows=9, chunk=2) == want


def test_empty_tables_and_single_labels(spark):
    assert found(spark, []) == []
    assert found(spark, [(k, [1.0, 0.5], 1, "", 0) for k in range(9)]) == []  # no other label
    assert found(spark, [(k, [1.0, 0.5], k, "", 0) for k in range(9)]) == []  # no positive


def test_products_beyond_doubles_are_exact():
    import numpy as np

    a = np.array([[(1 << 27) - 1, 3, 1 << 27]] * 2, np.int64)
    b = np.array([[(1 << 27) - 5, 7, -(1 << 27)], [1, 1, 1]], np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert hard_negatives.product(a, b).tolist() == want
