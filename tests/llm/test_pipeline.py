import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from doclattice.llm import mixing, quality_rules
from doclattice.llm.queries import tokenizer_path
from tests.llm.test_line_dedup import L
from tests.llm.test_near_join import brute
from tests.llm.test_quality_rules import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    good = P.quality(spark, docs, sf_dir)
    assert good.columns == P.COLUMNS
    rules = quality_rules.learn_list(quality_rules.labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    stats = {r.doc_id: r for r in quality_rules.with_statistics(docs).collect()}
    want = {i for i, r in before.items() if (b := base(r.text))[0] >= 50 and 2 * b[4] <= b[0] and not any(quality_rules.covers(x, stats[i]) for x in rules)}
    kept = {r.doc_id: r for r in good.collect()}
    assert kept.keys() == want and all(kept[i] == before[i] for i in kept) and 0 < len(kept) < len(before)

    clean = P.lines(spark, good, sf_dir)
    pages, held = {}, {}
    for r in {(r.source, r.text): r for r in kept.values()}.values():  # copies count once
        pages[r.source] = pages.get(r.source, 0) + 1
        for x in {x for x in r.text.split("\n") if x.strip()}:
            held[r.source, x] = held.get((r.source, x), 0) + 1
    bad = {k for k, n in held.items() if n > 1 and n > L.RATIO * pages[k[0]]}
    cleaned = {r.doc_id: r for r in clean.collect()}
    assert cleaned.keys() == kept.keys() and clean.columns == P.COLUMNS
    for i, r in cleaned.items():
        assert r.text == "\n".join(x for x in kept[i].text.split("\n") if (r.source, x) not in bad) and r.n_chars == len(r.text)

    single = P.near_duplicates(spark, clean, sf_dir)
    classes = brute([(r.doc_id, r.text) for r in cleaned.values()])
    alone = {r.doc_id: r for r in single.collect()}
    assert alone.keys() == {c for _, c, _ in classes} and all(alone[i] == cleaned[i] for i in alone)

    mixed = P.mix(spark, single, sf_dir)
    times = {r.doc_id: r.times for r in mixing.mix(single).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == P.COLUMNS and {i: got.count(i) for i in times} == times

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = P.encode(spark, mixed, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(got)
    for r in out[:50]:
        e = lib.encode(alone[r.doc_id].text, add_special_tokens=False)
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == e.ids and r.n_tokens == len(e.ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_hard_rows(spark, sf_dir):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(80))
    one, other = text(), text()
    rows = [(None, one, None, None, 1), (None, one, "en", "s", 1), (4, one, "en", "s", 1), (4, one, "en", "s", 1), (None, other, None, "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id is None for r in P.quality(spark, docs, sf_dir).collect()) == [False] * 2 + [True] * 3
    assert sorted((r.text or "")[:9] for r in P.near_duplicates(spark, docs, sf_dir).collect()) == sorted([one[:9], other[:9], "", ""])
    assert P.lines(spark, docs, sf_dir).count() == 7
    mixed = P.mix(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in P.encode(spark, mixed, sf_dir).collect()) == sorted(str(r.doc_id) for r in mixed.collect())
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_long_texts_clashing_columns_and_many_repeated_rows(spark, sf_dir):
    """Columns named like those that stages make, one text of 200,000 words, and a row 300 times."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i:] + words[:i]), "en", "s", 1) for i in range(5)] + [(9, "long " + " ".join(f"x{i % 9973}" for i in range(200_000)), "en", "s", 1)]
    rows += [(3, rows[3][1], "en", "s", 1)] * 300
    docs = spark.createDataFrame([(*r, "a", 2.0, "b", 7, "c") for r in rows], SCHEMA + ", digest string, position double, rank string, n_words int, token_ids string")
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == P.COLUMNS or name == "BPE"
        n = out.count()
        assert n == {"line dedup": 306, "n-gram Jaccard join": 2, "BPE": 306}.get(name, n) and n > 0


def test_rank_is_the_written_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = P.mix(spark, docs, sf_dir)
    mixed.write.parquet(str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    out = {r["rank"]: r.doc_id for r in P.encode(spark, back, sf_dir).select("rank", "doc_id").collect()}
    assert sorted(out) == list(range(back.count()))
    places = {}
    for r in mixing.mix(docs).select("doc_id", "positions").collect():
        places[r.doc_id] = iter(r.positions)
    at = [next(places[out[k]]) for k in range(len(out))]
    assert at == sorted(at)
    assert {r["rank"] for r in P.encode(spark, docs.limit(0).unionByName(docs.limit(3)), sf_dir).collect()} == {None}


def test_copies_of_a_document_leave_one(spark, sf_dir):
    word = lambda i, j: f"w{i}x{j}"
    own = lambda i: "\n".join(" ".join(word(i, 10 * k + j) for j in range(10)) for k in range(8))
    rows = [(i, "head line\n" + own(i if i > 20 else 0), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = P.lines(spark, docs, sf_dir)
    assert {r.doc_id: r.text for r in clean.collect()} == {i: own(i if i > 20 else 0) for i in range(60)}
    single = P.near_duplicates(spark, clean, sf_dir)
    assert {r.doc_id: r.text for r in single.collect()} == {i: own(i) for i in [0, *range(21, 60)]}
