"""The divergence audit against plain arithmetic, with blocks of a few terms and sources."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from doclattice.llm import divergence
from doclattice.llm.common import prepare

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, least=10, top=10):
    groups, held = {}, {}
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        w = TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(w)
        held.setdefault(lang, Counter()).update(set(w))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, by in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def p_of(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: p_of(c) for s, c in by.items()}
        q = p_of(sum(by.values(), Counter()))
        for s in by:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if by[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -x, k) for k, (x, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -x, k) for k, (x, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def cases(n=300, sources=7):
    r = random.Random(11)
    vocabulary = ["the", "The", "Öl", "öl", "x", "日本語", "ümlaut", "don't", "a-b", "Z9z"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)]
    docs = []
    for _ in range(n):
        s = 0 if r.random() < 0.4 else r.randrange(sources)
        words = [vocabulary[min(len(vocabulary) - 1, int(r.expovariate(0.03 * (1 + s % 3))))] for _ in range(r.randrange(0, 60))]
        docs.append((" ".join(words), r.choice(["en", "de", None]), f"src{s}" if s else None))
    return docs + [(None, "en", "no terms"), ("12 34", "en", "no terms"), ("only here", "fr", "alone"), ("q", "it", "a"), (None, "it", "b"), ("x " * 20000, "en", "src1")] + docs[:3]


def found(spark, docs, **more):
    prepare(spark)
    df = spark.createDataFrame([(*d, "clash", 9) for d in docs], "text string, lang string, source string, term string, n int")
    return sorted(tuple(r) for r in divergence.audit(df, **more).collect())


@pytest.mark.parametrize("blocks", [{}, {"block_terms": 7, "block_sources": 2}, {"block_terms": 1000, "block_sources": 3}])
def test_equals_plain_arithmetic(spark, blocks):
    docs = cases()
    want = brute(docs)
    assert {x[2] for x in want} == {"pair", "term"} and len({x[0] for x in want}) == 4
    assert found(spark, docs, **blocks) == want


def test_full_tables_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_TERMS", 20)
    docs = cases(80)
    assert found(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_shares_are_exact_beyond_doubles():
    for count, total, v in [(0, 0, 1), (10**15, 3 * 10**15, 10**6), (9 * 10**14 + 1, 9 * 10**14 + 7, 3)]:
        got = divergence.shares(np.array([count], np.int64), np.array([total], np.int64), v)
        assert got.tolist() == [1 + 10**9 * (count + 2) // (total + 2 * v)]


def test_no_table_of_its_own_for_each_document(spark, monkeypatch):
    made = []

    class Table(divergence.Counter):
        def __init__(self, *of):
            made.append(1)
            super().__init__(*of)

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        groupBy = agg = select

    monkeypatch.setattr(divergence, "Counter", Table)
    docs, rng = Docs(), random.Random(2)
    texts = [" ".join(rng.choice(["Aé", "b", "ßx", "日本", "c9d", "-"]) for _ in range(30)) for _ in range(50)]
    divergence.term_counts(docs)
    batch = divergence.pa.RecordBatch.from_pydict({"lang": ["l"] * 50, "source": ["s", "t"] * 25, "text": texts})
    rows = [r for b in docs.run(iter([batch])) for r in b.to_pylist()]
    words = lambda t: t.replace("A", "a").replace("9", " ").replace("-", " ").split()
    for s in (0, 1):
        want = {w: (sum(words(t).count(w) for t in texts[s::2]), sum(w in words(t) for t in texts[s::2])) for t in texts[s::2] for w in words(t)} | {None: (0, 0)}
        assert {r["term"]: (r["n"], r["docs"]) for r in rows if r["source"] == "st"[s]} == want
    assert len(made) == 4
