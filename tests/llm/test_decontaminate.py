"""Decontamination against a search of word lists."""

import random
import re

import pytest

from doclattice.llm import decontaminate
from doclattice.llm.common import prepare

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    import hashlib

    out = []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            own = words(t)
            size = min(10, len(own))
            wins = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for at in range(len(w) - size + 1) if own else ():
                if tuple(w[at : at + size]) in wins:
                    hit.update(range(at, at + size))
                    if item is not None:
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    prepare(spark)
    d = spark.createDataFrame([(*x, "extra", 1) for x in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, shard int")
    rows = decontaminate.audit(d, b, **more).drop("spans", "items").collect()
    return sorted((tuple(r) for r in rows), key=str)


def cases():
    r = random.Random(3)
    vocabulary = ["ab", "a", "Ünder", "x9", "LONGER", "words", "é", "straße", "42", "日本"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([1, 3, 9, 10, 11, 14, 30]))) for k in range(30)]
    items += [(7, items[7][1]), (40, items[3][1]), (None, text(12)), (41, None), (42, ""), (43, "... !!"), (10, "a, a, a, a, a, a, a, a, a, a, a, a")]
    docs = []
    for k in range(60):
        parts = [text(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 3)):
            w = words(items[r.randrange(30)][1])
            at = r.randrange(0, max(1, len(w) - 10))
            parts += [r.choice(["; ", "\n", " -- "]).join(w[at : at + r.choice([9, 10, 12])]), text(r.randrange(0, 5))]
        docs.append((k, r.choice([" ", ".\x00 "]).join(parts)))
    docs += [docs[0], docs[0], (None, docs[1][1]), (90, None), (91, ""), (92, " .,! "), (93, "a " * 5000), (94, items[2][1].upper())]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert sum(x[-1] for x in want) > 20 and sum(not x[-1] for x in want) > 3
    assert found(spark, docs, items) == want


def test_shards_give_the_same(spark):
    docs, items = cases()
    assert found(spark, docs, items, shard_bytes=4000) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert found(spark, [], items) == []
    assert found(spark, docs[:5], []) == brute(docs[:5], [])


def test_filter_keeps_clean_documents(spark):
    prepare(spark)
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"so {passage.upper()} it goes"), (2, "one two three four five six seven eight nine, eleven"), (None, "clean")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert sorted((r.doc_id for r in decontaminate.without_hits(d, b).collect()), key=str) == [2, None]


@pytest.mark.parametrize("seed", range(4))
def test_searcher_finds_every_place(seed):
    """All occurrences, overlapping ones too, of strings that share prefixes and blocks."""
    r = random.Random(seed)
    text = bytes(r.choice(b"ab ") for _ in range(4000))
    strings = list({text[a : a + r.randrange(3, 40)] for a in (r.randrange(3900) for _ in range(150))} | {b"zzz"})
    for block in (1, 4, 12):
        got = sorted(decontaminate.Searcher(strings, block).find(text))
        assert got == sorted((k, s) for s in strings for k in range(len(text)) if text.startswith(s, k))
