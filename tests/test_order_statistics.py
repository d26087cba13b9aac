"""Places of sorted groups against sorting, in many narrow passes too."""

import math
import random

import pytest
from pyspark.sql import functions as F

from doclattice.operators import order_statistics

PLACES = {"first": lambda n: F.lit(0), "p50": lambda n: F.floor(n * 0.5), "p95": lambda n: F.floor(n * 0.95), "last": lambda n: n - 1}


def rows():
    rng, out = random.Random(5), []
    for _ in range(3000):
        out.append(("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 7.0, 10 ** rng.uniform(-300, 300), -rng.random()])))
    return out + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None), ("none", float("nan")), ("a", None), ("ends", -1.7e308), ("ends", 1.7e308), ("ends", 0.0)]


@pytest.mark.parametrize("bins, few", [(1024, None), (1024, 5), (2, 1), (7, 0)])
def test_equals_sorting(spark, bins, few):
    groups = {}
    for g, v in rows():
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    want = {(g, s[0], s[len(s) // 2], s[math.floor(len(s) * 0.95)], s[-1]) for g, s in ((g, sorted(v)) for g, v in groups.items())}
    df = spark.createDataFrame([(g, v, "x", 1) for g, v in rows()], "g string, value double, lo string, m int")
    got = order_statistics.at_places(df, ["g"], "value", PLACES, bins, few)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["g", *PLACES]


def test_empty(spark):
    assert order_statistics.at_places(spark.createDataFrame([], "g int, value float"), ["g"], "value", PLACES).count() == 0
