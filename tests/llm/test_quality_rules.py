import random
import re
from collections import Counter

import pytest

from doclattice.llm import quality_rules as Q
from doclattice.llm import queries

SCHEMA = "doc_id long, text string, n_words string, source string"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(zip(words, words[1:], words[2:]))
    places = set()
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            places |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(places)


def texts():
    rng = random.Random(2)
    out = [None, "", " \t\r\n", "a", "a b", "a b c", "a b c a b c", "x " * 9000, "a b c d " * 4000, "l\nl\n\nl\n", "é#*$ %&|<> \x0b\x0cz\xa0z"]
    return out + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) + rng.choice(["\n", "\n\n a", ""]) for _ in range(60)]


def test_statistics_equal_brute_force(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(texts())] * 2
    got = Q.apply_list(spark.createDataFrame(rows, SCHEMA), []).collect()
    assert len(got) == len(rows)
    by_id = dict(enumerate(texts()))
    for r in got:
        want = base(by_id[r.doc_id])
        assert tuple(r[c] for c in Q.BASE) == want, by_id[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_list_is_learned_and_applied_in_order(spark):
    rng = random.Random(4)
    rows = [{s: rng.random() for s in Q.STATS} for _ in range(900)]
    for r in rows:
        r["reject"] = int(r["symbol_ratio"] >= 0.9 or (r["mean_word"] < 0.3 and r["upper_ratio"] >= 0.6))
    rules = Q.learn_list(rows)
    hit = lambda r: any(Q.covers(x, r) for x in rules)
    assert len(rules) >= 2 and sum(hit(r) == bool(r["reject"]) for r in rows) > 0.97 * len(rows)
    df = spark.createDataFrame([tuple(r[s] for s in Q.STATS) for r in rows], Q.STATS).select(Q.rule_column(rules).alias("k"))
    assert [r.k for r in df.collect()] == [next((k for k, x in enumerate(rules, 1) if Q.covers(x, r)), 0) for r in rows]


@pytest.mark.parametrize("rows", [[], [{s: 1.0 for s in Q.STATS} | {"reject": 1}]])
def test_nothing_to_learn(rows):
    assert Q.learn_list(rows) == []


def test_query(spark, sf_dir):
    got = queries.op4_quality_rules(spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(text) and 0 < sum(r.kept for r in got) < len(got)
    assert all(tuple(r[c] for c in Q.BASE) == base(text[r.doc_id]) for r in got)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert Q.labelled_rows(docs, labels) == [] and Q.apply_list(docs, []).count() == 0


def test_no_cap_on_rules():
    """As many rules as there are statistics, each for documents of its own."""
    none = dict.fromkeys(Q.STATS, 0.0)
    rows = [none | {s: 10.0, "reject": 1} for s in Q.STATS for _ in range(60)] + [none | {"reject": 0} for _ in range(900)]
    random.Random(3).shuffle(rows)
    rules = Q.learn_list(rows)
    assert len(Q.STATS) == 13 and {rule[0].stat for rule in rules} == set(Q.STATS)


def test_no_cap_on_conditions():
    """Six conditions are needed to tell the rejected documents apart."""
    rng, stats = random.Random(5), Q.STATS[:6]
    rows = []
    for _ in range(6000):
        values = {s: float(rng.random() < 0.75) for s in Q.STATS}
        rows.append(values | {"reject": int(all(values[s] for s in stats))})
    rules = Q.learn_list(rows)
    assert [sorted(c.stat for c in rule) for rule in rules] == [sorted(stats)]


def test_labels_of_other_documents_take_no_place(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = Q.labelled_rows(docs, labels, most=100)
    assert len(rows) == 40 and sum(r["reject"] for r in rows) == 20
