"""Keywords by automaton against substring tests, and the names in questions."""

import random

import pytest
from pyspark.sql import functions as F

from doclattice.operators import dictionary, entities


def texts():
    rng = random.Random(6)
    out = ["".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 5, 60, 3000]))) for _ in range(150)]
    return list(enumerate(out + [out[3], "日本語 text", None]))


WORDS = ["a", "ab", "abc", "bca", "é", " ", "a b", "本", "zzz", "abcabcabc", "c a", "ba"]


@pytest.mark.parametrize("words, shard_bytes", [(WORDS, 1 << 20), (WORDS, 5), ([*WORDS, "", None, "a"], 5), ([], 5), ([None], 5)])
def test_hits_equal_substrings(spark, words, shard_bytes):
    t = spark.createDataFrame(texts(), "id long, text string")
    k = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = sorted((r.id, r.keyword) for r in dictionary.keyword_hits(t, "id", "text", k, shard_bytes).collect())
    assert got == sorted((i, w) for i, x in texts() for w in {w for w in words if w is not None} if x is not None and w in x)


def test_a_million_keywords(spark):
    words = spark.range(1_000_000).select(F.concat(F.lit("unit "), F.col("id"), F.lit(" of")).alias("keyword"), F.concat(F.lit("c"), F.col("id") % 1000).alias("code"))
    t = spark.createDataFrame([(1, "UNIT 77 OF and unit 999999 of it"), (2, "unit 1000000 of"), (3, "unit 5 of unit 5 of unit 1005 of")], "id long, text string")
    assert sorted((r.id, r.code) for r in entities.dictionary_hits(t, "id", "text", words).collect()) == [(1, "c77"), (1, "c999"), (3, "c5")]


def test_names_in_questions(spark):
    names = ["Fuel oil pump", "fuel OIL pump", "Pump", "valve", "PU3", "Separator", "separators", "ab", "HGM-30", "Cylinder", "tank top", "Lube", "oil-mist"]
    asked = [
        ("a", "Where is the fuel oil pump, PU3 or pump?"), ("b", "SEPARATORS near HGM-30, SV4, SV4, hgm-30 and CR-302"), ("c", "Lube valve cylinder"), ("d", None), (None, "PU3"),
        ("e", "oil-mist in tank top: A1 B22 C333 D4444 EEEE55555 ABCDE1 X-123456"), ("f", ""),
    ]
    q = spark.createDataFrame(asked, "q string, question string")
    found = entities.question_entities(q, "q", "question", spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.q, r.k)):
        got.setdefault(r.q, []).append(r.name)
    assert got == {
        "a": ["Fuel oil pump", "PU3"],
        "b": ["separators", "Separator", "HGM-30", "CR-302", "SV4"],
        "e": ["EEEE55555", "oil-mist", "tank top", "D4444", "C333"],
    }
