import random
import re

import pytest

from doclattice.llm import line_dedup as L
from doclattice.llm import queries

SCHEMA = "doc_id long, source string, text string, lines int, line_count string"


def rows():
    rng = random.Random(6)
    out = [(None, None, None, 1, "x"), (1, None, "", 1, "x"), (2, "s0", "foot\n" * 2000, 1, "x")]
    for i in range(3, 400):
        body = [rng.choice(["foot", "head ", " \t", "", f"own {i}", f"own {i % 40}", "a" * 3000]) for _ in range(rng.randrange(1, 9))]
        out.append((i, rng.choice(["s0", "s0", "s1", "s2", None]), "\n".join(body), 1, "x"))
    return out + out[:3]


def brute(ratio):
    pages, held = {}, {}
    has_word = re.compile(r"[^\x20\x09-\x0D]")
    for _, s, t, _, _ in rows():
        pages[s] = pages.get(s, 0) + 1
        for line in {x for x in (t or "").split("\n") if has_word.search(x)}:
            held[s, line] = held.get((s, line), 0) + 1
    bad = {k for k, n in held.items() if n > 1 and n > ratio * pages[k[0]]}
    out = []
    for i, s, t, _, _ in rows():
        left = None if t is None else [x for x in t.split("\n") if (s, x) not in bad]
        out.append((i, s, None if t is None else "\n".join(left), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [10**6, 0])
def test_against_brute_force(spark, most):
    queries.prepare(spark)
    got = L.drop_boilerplate(spark.createDataFrame(rows(), SCHEMA), 0.1, broadcast_hashes=most).collect()
    assert sorted(((r.doc_id, r.source, r.text, r.line_count, r.dropped_count) for r in got), key=str) == brute(0.1)
    assert sum(r.dropped_count for r in got) > 1000


def test_empty(spark):
    queries.prepare(spark)
    assert L.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_hosts(spark):
    """The ratio decides on hosts of any size: a line on both pages of a host of two goes, one on a single page stays."""
    queries.prepare(spark)
    rows = [(1, "two", "both\none", 1, "x"), (2, "two", "both\nother", 1, "x"), (3, "single", "alone\nalone", 1, "x")]
    assert {r.doc_id: r.text for r in L.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: "one", 2: "other", 3: "alone\nalone"}
