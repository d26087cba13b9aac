import random

import pytest

from doclattice.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, size string, rank int"


def rows(n=600):
    rng = random.Random(8)
    out = [(None, None, None, "x", 1), (5, "empty", "", "x", 1), (5, "empty", None, "x", 1)]
    for i in range(n):
        out.append((i, rng.choice(["b", "b", "b", "c", "a", "Z", None]), " ".join(["w"] * rng.choice([0, 3, 20, 90])), "x", 1))
    return out + [(7, "c", "w " * 5000, "x", 1)] + out[:4]


def targets(sizes):
    """By the wording: share the budget by weight, stop those above twice their size, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, budget = set(), 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in sizes if s not in capped)
        now = {s: 2 * sizes[s] if s in capped else left * weight[s] / total for s in sizes}
        over = {s for s in sizes if s not in capped and now[s] > 2 * sizes[s]}
        if not over:
            return now
        capped |= over


def test_targets_and_taken(spark):
    got = M.mix(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(got) == len(rows())
    sizes = {}
    for _, s, t, _, _ in rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken, most = targets(sizes), {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(spark.createDataFrame(rows()[::-1], SCHEMA)).collect()))


def test_positions_follow_the_schedules(spark):
    mixed = M.mix(spark.createDataFrame(rows(4000), SCHEMA))
    got = M.curriculum(mixed, partitions=4).collect()
    assert all(len(r.positions) == r.times for r in mixed.collect())
    at = [r.position for r in got]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert sum(r.size for r in got) == sum(r.taken for r in mixed.collect())
    rank = {r.source: r["rank"] for r in mixed.select("source", "rank").distinct().collect()}
    for source in ("b", "c", "a"):
        schedule = M.SCHEDULES[rank[source] % 3]
        area = lambda end: sum(
            (min(t1, end) - t0) * (w0 + w0 + (w1 - w0) * (min(t1, end) - t0) / (t1 - t0)) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t0 < end
        )
        mine = [(r.position, r.size) for r in got if r.source == source]
        total = sum(n for _, n in mine)
        for end in (0.25, 0.5, 0.8):
            assert sum(n for p, n in mine if p < end) / total == pytest.approx(area(end) / area(1.0), abs=0.08), (source, end)


def test_untaken_rows_and_empty_table(spark):
    mixed = M.mix(spark.createDataFrame(rows(), SCHEMA))
    assert M.curriculum(mixed, untaken=True).where("copy <= 1").count() == len(rows())
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
