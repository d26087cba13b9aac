import random

import numpy as np
import pytest

from doclattice.llm import near_join as N
from doclattice.llm import queries

SCHEMA = "doc_id long, text string, digest string, root int"


def sets(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    ids = {}
    for i in range(n):
        if rows[i][0] is not None:
            ids[find(i)] = min(ids.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], ids.get(find(i)) if s[i] else rows[i][0], links[i]) for i in range(n)), key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, None, "", " \n", "one", "one", "two words", "a b c d e", "a b c d e", "é é é é é é " * 3000]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([30, 80, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    base = [word() for _ in range(120)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(120)] = word()
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(None, texts[20]), (None, "nobody else has this text at all")]
    return rows + [rows[25], rows[25]]


@pytest.mark.parametrize("block", [512, 10])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_TEXTS", block)
    queries.prepare(spark)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in N.join_documents(df).collect()), key=str)
    assert got == brute(rows)


def test_prefix_is_shortened_to_the_recall():
    assert N.prefix_length(recall=0.0) == N.DEPTH and N.prefix_length(recall=0.998) == 5 and N.prefix_length(recall=1.0) == 1
    k = N.prefix_length()
    assert 1 - (1 - 0.8**k) ** N.TREES >= N.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** N.TREES


def signed(h, depth):
    return N.labels(h).view(np.uint64) >> np.uint64(64 - 8 * depth)


def test_measured_recall_at_the_threshold():
    rng, found = np.random.RandomState(3), 0
    for _ in range(400):
        h = N.mixed(rng.randint(0, 2**62, 110).astype(np.uint64))
        a, b = np.sort(h[:100]), np.sort(np.concatenate([h[:88], h[100:]]))  # 88 of 110: 0.8
        found += (signed(a, N.prefix_length()) == signed(b, N.prefix_length())).any()
    assert found >= 0.985 * 400


def test_labels_meet_as_often_as_estimated():
    """Depth by depth, for pairs of similarity 0.8: the share that meets is the one that estimates rest on."""
    rng, met = np.random.RandomState(5), np.zeros(N.DEPTH + 1)
    for _ in range(300):
        h = N.mixed(rng.randint(0, 2**62, 110).astype(np.uint64))
        a, b = np.sort(h[:100]), np.sort(np.concatenate([h[:88], h[100:]]))
        for d in range(5, N.DEPTH + 1):
            met[d] += (signed(a, d) == signed(b, d)).any()
    for d in range(5, N.DEPTH + 1):
        assert met[d] / 300 == pytest.approx(N.meeting(np.array([0.8]), d)[0], abs=0.04)


def test_dense_texts_settle_deep_and_lose_no_link(spark, monkeypatch):
    """A cluster of close copies is settled at whole labels: its pairs aren't met again at shorter prefixes; a distant copy still finds all of it."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(400)]
    rows = []
    for i in range(80):
        t = list(base)
        t[rng.randrange(400)] = word()
        rows.append((i, " ".join(t)))
    far = list(base)
    for k in range(0, 400, 60):
        far[k] = word()
    rows.append((80, " ".join(far)))
    queries.prepare(spark)
    asked, plain = {}, N.members_at
    monkeypatch.setattr(N, "members_at", lambda r, d: asked.setdefault(d, plain(r, d).checkpoint()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in N.join_documents(df).collect()), key=str)
    assert got == brute(rows)
    assert asked[N.DEPTH].count() > 80 and all(asked[d].where("i = j").select("digest").distinct().count() <= 2 for d in asked if d < N.DEPTH)


@pytest.mark.parametrize("hot", [0, 10**9])
def test_nodes_beyond_the_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(N, "HOT_TEXTS", 5 if not hot else hot)
    queries.prepare(spark)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in N.join_documents(df).collect()), key=str) == brute(rows)


def test_query(spark, sf_dir):
    """Over the whole smallest table, against all pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in queries.op3_jaccard_join(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


def test_components_of_paths_and_stars(spark):
    queries.prepare(spark)
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(path, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_empty(spark):
    queries.prepare(spark)
    assert N.join_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_near_identical_partner_settles_nothing(spark):
    """Groups {a, a', b, b'}: a' and b' differ from a and b by white space, a from b at J = 0.818. All links are found through the forest."""
    queries.prepare(spark)
    rng, rows = random.Random(4), []
    for g in range(120):
        words = [f"w{rng.randrange(10**9)}" for _ in range(64)]
        other = [*words[:-6], *(f"v{rng.randrange(10**9)}" for _ in range(6))]  # 60 shingles each, 54 in common
        for k, t in enumerate((" ".join(words), "  ".join(words), " ".join(other), "  ".join(other))):
            rows.append((4 * g + k, t))
    got = N.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r.n_links for r in got)
    assert found >= 0.998 * 12 * 120 and len({r.class_id for r in got}) <= 121
