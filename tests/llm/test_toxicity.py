import random
import zlib

import pytest

from doclattice.llm import queries
from doclattice.llm import toxicity as X

SCHEMA = "doc_id long, text string, score string, hits int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_automaton_equals_edit_distance(edits, monkeypatch):
    rng = random.Random(edits)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(12)})
    auto = X.Automaton(terms, edits)
    monkeypatch.setattr(X.Automaton, "MOST", 50)
    for _ in range(1500):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8)))
        want = min(((distance(w, t), t) for t in terms), default=None)
        assert auto.match(w) == ((want[1], want[0]) if want[0] <= edits else None)


def corpus(n=1500):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    out = []
    for i in range(n):
        t, toxic = [rng.choice(words) for _ in range(60)], i % 8 == 0
        for _ in range(rng.randrange(1, 4) * toxic):
            t[rng.randrange(60)] = rng.choice(["slurword", "nastiest", "Vilestem" + rng.choice(words)])
        out.append((i, " ".join(t), int(toxic)))
    return out


def test_learned_model_finds_terms_stems_and_misspellings():
    rows = corpus()
    model = X.learn([(t, y) for i, t, y in rows if i % 5])
    score = model.scorer()
    assert all((score(t)[0] >= 0.5) == bool(y) for i, t, y in rows if i % 5 == 0)
    clean = next(t for _, t, y in rows if not y)
    assert [h[2] for h in score(clean + " slurwrd nastieest")[1]] == [1, 1]
    assert score("")[0] == score(None)[0] == score(clean)[0] < 0.5
    assert [h[3] for h in score("they said “slurword” there")[1]] == [True] and [h[3] for h in score("you slurword")[1]] == [False]
    assert 0 <= score("slurword " * 20_000)[0] <= 1
    used, base = score(clean + " they have slurword there")[0], score(clean)[0]
    assert base < score(clean + " they have “slurword” there")[0] < used and score(clean + " she said slurword there")[0] < used
    assert min(model.weights[1:]) >= 0


def test_no_list_of_terms_is_cut():
    """400 toxic words, each in documents of its own, all become terms."""
    words = ["".join(chr(97 + (k // 26**j) % 26) for j in range(3)) + "zq" for k in range(400)]
    rows = [(f"some plain text {w}", 1) for w in words for _ in range(6)] + [("some plain text", 0)] * 20_000
    assert set(words) <= set(X.learn(rows).lexicon.terms)


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert X.training_rows(docs, labels, most_bytes=10_000).count() == 10


def test_labels_of_other_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    trained = sorted(r.text for r in X.training_rows(docs, labels, most=100).collect())
    assert trained == sorted(f"word {i}" for i in range(40) if zlib.crc32(str(i).encode()) % 5)


def test_a_text_that_does_not_fit_leaves_the_others(spark):
    docs = spark.createDataFrame([(i, "x" * (1200 if i == 7 else 15)) for i in range(40)] + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    trained = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert 7 in trained and X.training_rows(docs, labels, most_bytes=1000).count() == len(trained) - 1
    assert X.training_rows(docs, labels, most_bytes=2000).count() == len(trained)


@pytest.mark.parametrize("rows", [[], [("a", 1)], [("a", 0), (None, 0)]])
def test_one_kind_of_labels(rows):
    got = X.learn(rows).scorer()("a b c")
    assert (got[0] >= 0.5) == bool(rows and rows[0][1]) and got[1] == []


def test_columns_and_query(spark, sf_dir):
    model = spark.sparkContext.broadcast(X.Model(X.Lexicon({"badword": False}), [-1.0, 3.0] + [0.0] * (len(X.FEATURES) - 1)))
    rows = [(1, None, "x", 1), (None, "a Badword", "x", 1), (1, "", "x", 1), (1, "", "x", 1)]
    got = X.score_column(queries.prepare(spark) and spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == 4 and sorted(r.score > 0.5 for r in got) == [False, False, False, True]
    assert X.score_column(spark.createDataFrame([], SCHEMA), model).count() == 0
    out = queries.op7_toxicity(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_rows_are_told_apart(spark):
    """Area under the curve of the query's scores over the labelled rows of the held-out fold."""
    sf_dir = "/root/testdata/sf0.1"
    out = queries.op7_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("score", "toxic").collect()
    bad, good = [r.score for r in out if r.toxic], [r.score for r in out if r.toxic == 0]
    assert len(bad) > 50 and sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good) >= 0.96
