"""Top overlaps against counting all pairs, with phrases that most contexts have."""

import random

import pytest

from doclattice.operators import attribution


def shingles(text):
    w = text.lower().split()
    return {p for p in (" ".join(w[i : i + 3]) for i in range(len(w) - 2)) if len(p) > 10}


def cases():
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = [text(6) for _ in range(4)]
    answers = [(i, text(12) + rng.choice(common) + text(5)) for i in range(20)]
    answers += [(30, common[0] + common[1]), (31, common[2]), (32, []), (33, text(2))]
    contexts = []
    for c in range(300):
        parts = text(20)
        for _ in range(rng.randrange(3)):
            parts += rng.choice(common)
        if c % 7 == 0:
            own = answers[rng.randrange(20)][1]
            at = rng.randrange(0, 12)
            parts += own[at : at + rng.randrange(3, 9)]
        contexts.append((c, parts))
    join = lambda rows: [(k, " ".join(w)) for k, w in rows]
    return join(answers), join(contexts) + [(900, None), (901, "")]


@pytest.mark.parametrize("hot, k", [(1000, 5), (30, 5), (3, 2), (0, 5), (30, 1000)])
def test_equals_all_pairs(spark, hot, k):
    answers, contexts = cases()
    want = set()
    for i, a in answers:
        own = shingles(a)
        shared = sorted((-len(own & shingles(c)), j) for j, c in contexts if c and own & shingles(c))
        want |= {(i, j, -n, len(own), r) for r, (n, j) in enumerate(shared[:k], 1)}
    a = spark.createDataFrame([*answers, (None, answers[0][1]), (40, None)], "item_id long, answer string")
    c = spark.createDataFrame(contexts, "doc_id long, context string")
    got = attribution.top_overlaps(a, c, "item_id", "doc_id", k, hot, salts=5).collect()
    assert {(r.item_id, r.doc_id, r.common, r.phrases, r.k) for r in got} == want and len(got) == len(want) > 0
