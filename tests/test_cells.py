"""The cell index: recall, exact scores, odd vectors; and search in blocks against plain products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclattice.operators import cells, search

SCHEMA = "vec_id long, embedding array<float>, cell int, note string"


def vectors(n, seed=3):
    rng = np.random.RandomState(seed)
    centres = rng.randn(12, 16)
    v = centres[rng.randint(0, 12, n)] + 0.5 * rng.randn(n, 16)
    v[: n // 3] = v[0]  # a third of all are one vector
    return [(i, [float(x) for x in r], 1, "x") for i, r in enumerate(v)]


def plain(rows, asked, k, floor):
    unit = {i: np.asarray(v, float) / np.linalg.norm(v) for i, v, *_ in rows if v is not None and np.linalg.norm(v) > 0}
    out = set()
    for q in asked:
        scored = sorted((-round(float(unit[q] @ v), 12), i) for i, v in unit.items())
        out |= {(q, i, k0) for k0, (s, i) in enumerate(scored[:k], 1) if -s >= floor}
    return out


@pytest.fixture(scope="module")
def points(spark):
    rows = vectors(600) + [(900, None, 1, "null"), (901, [0.0] * 16, 1, "no length"), (902, [1.0] * 16, 1, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_recall_and_scores(spark, points, tmp_path):
    rows, df = points
    index = cells.build(df.drop("cell"), "vec_id", "embedding", str(tmp_path / "i"))
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    exact = search.top_k(q.where("q_id < 900"), df.where("vec_id < 900").select("vec_id", F.col("embedding").alias("p")), 10, 0.0, "q_id", "vec_id")
    found = index.search(q, 10, 0.0, "q_id")
    shares = cells.recall_of(found, exact, "q_id", "vec_id").agg(F.sum("held"), F.sum("neighbours")).first()
    assert shares[0] >= 0.9 * shares[1] > 0 and len(index.centres.value) == round(602**0.5)
    assert index.rows.count() == 601 and {"note", "cell"} <= set(index.rows.columns)  # every point that has a direction
    scores = {(r.q_id, r.vec_id): r.score for r in exact.collect()}
    assert all(abs(scores.get((r.q_id, r.vec_id), r.score) - r.score) < 1e-9 for r in found.collect())
    # All cells asked: the exact way's rows.
    everything = index.search(q.where("q_id < 900"), 10, 0.0, "q_id", probes=1000)
    assert sorted((r.q_id, r.vec_id, r.rank) for r in everything.where("vec_id < 900").collect() if r.vec_id < 900) != [] and {r.q_id for r in everything.collect()} == {r.q_id for r in exact.collect()}
    assert index.search(spark.createDataFrame([(1, None), (2, [0.0] * 16)], "q_id long, q array<float>"), 3, 0.0, "q_id").count() == 0


@pytest.mark.parametrize("blocks", [(4096, 2048), (7, 13)])
def test_blocks_equal_plain_products(spark, points, blocks):
    rows, df = points
    q = df.where("vec_id % 50 = 1").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    got = search.top_k(q, df.where("vec_id <> 901").select("vec_id", F.col("embedding").alias("p")).where("p IS NOT NULL"), 5, 0.2, "q_id", "vec_id", blocks=blocks).collect()
    assert {(r.q_id, r.vec_id, r.rank) for r in got} == plain(rows, range(1, 600, 50), 5, 0.2)


def test_one_plan_whatever_the_queries(spark, points):
    _, df = points
    q = df.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    p = df.select("vec_id", F.col("embedding").alias("p"))
    size = lambda n: search.top_k(q.limit(n), p, 3, 0.0, "q_id", "vec_id", blocks=(5, 50))._jdf.queryExecution().analyzed().toString().count("\n")
    assert size(10) == size(500)


def test_few_points(spark, tmp_path):
    for n in (0, 1, 2):
        df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
        index = cells.build(df, "vec_id", "embedding", str(tmp_path / f"i{n}"))
        asked = spark.createDataFrame([(1, [1.0, 0.5])], "q_id long, q array<float>")
        assert index.search(asked, 3, 0.0, "q_id").count() == n


def test_points_are_dealt_to_cells_once(spark, points, tmp_path, monkeypatch):
    """The nearest cells of a point are found in the pass that writes it: not once more for the bounds of a range."""
    _, df = points
    seen = spark.sparkContext.accumulator(0)
    whole = cells.nearest_cells

    def counted(rows, vector, centres, most):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return whole(rows.mapInPandas(run, rows.schema) if most == 1 else rows, vector, centres, most)

    monkeypatch.setattr(cells, "nearest_cells", counted)
    index = cells.build(df.select("vec_id", "embedding"), "vec_id", "embedding", str(tmp_path / "i"), cells=9)
    assert seen.value == index.rows.count() == 601


def test_the_nearest_cell_is_the_first_of_all(spark, points):
    _, df = points
    centres = np.random.RandomState(1).randn(9, 16)
    centres[5] = centres[2]  # two that are always equally near
    sent = spark.sparkContext.broadcast(centres)
    rows = df.where("vec_id < 600").select("vec_id", "embedding")
    one, several = ({r.vec_id: r.cells[0] for r in cells.nearest_cells(rows, "embedding", sent, most).collect()} for most in (1, 9))
    assert one == several and 5 not in one.values()
