"""What Python holds at a time: places in place of texts, slices in place of whole blocks."""

import os
import random
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import types as T_

from doclattice.llm import bpe, common, near_join
from doclattice.llm.queries import tokenizer_path
from doclattice.operators import chunking, search
from doclattice.plans import registry


def test_only_places_come_from_python(spark):
    assert {f.dataType for f in chunking.text_spans.returnType.elementType} == {T_.IntegerType()}
    rng = random.Random(4)
    texts = ["".join(rng.choice(["wörd ", "𝄞 ", "end. ", " ", "\n", "x" * 30]) for _ in range(n)) for n in (0, 1, 40, 900, 3000)] + [None, "   "]
    rows = chunking.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    expected = [(d, i, a, z, t[a:z].strip()) for d, t in enumerate(texts) for i, (a, z) in enumerate(chunking.chunk_spans(t or ""))]
    assert sorted(tuple(r) for r in rows) == expected


def test_slices_of_a_block(spark, monkeypatch):
    rng = random.Random(5)
    v = lambda: [float(rng.randrange(-9, 9)) for _ in range(8)]
    s = spark.createDataFrame([(i % 2, i, i, v()) for i in range(50)], "doc long, source long, section long, q array<double>")
    t = spark.createDataFrame([(i % 2, i // 3, i, v()) for i in range(90)], "doc long, section long, vec_id long, p array<double>")
    got = lambda: sorted(tuple(r)[:4] + (round(r.score, 9),) for r in search.top_by_blocks(s, t, "doc", "source", "section", "vec_id", 4).collect())
    whole = got()
    monkeypatch.setattr(search, "SLICE", 3)
    assert len(whole) == 200 and got() == whole


def test_counts_of_customers_repeat_no_row(spark, sf_dir, capsys):
    registry.queries()["a2_per_document_counts"](spark, sf_dir).explain()
    assert "Expand" not in capsys.readouterr().out


def test_tokenizers_leave_the_workers_that_the_near_join_takes_over(spark):
    """Workers go from stage to stage; the pipeline's last stage would leave its tokenizers beside the near-duplicate stage of the next run."""
    data = bpe.tokenizer_data(spark, tokenizer_path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string").repartition(4)

    def probe(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()], pa.int64()), "loaded": pa.array([len(bpe.LOADED)], pa.int64())})

    assert bpe.encode_column(docs, data).select("doc_id", "token_ids").collect()
    left = docs.mapInArrow(probe, "pid long, loaded long")
    assert max(r.loaded for r in left.collect())  # else this test shows nothing
    before = near_join.signed_texts(near_join.with_digest(docs.repartition(40)))
    assert before.count() == 40
    assert not max(r.loaded for r in docs.repartition(40).mapInArrow(probe, "pid long, loaded long").collect())
    assert bpe.encode_column(docs, data).where("length(token_ids) > 0").count() == 40  # loaded again


def test_arrow_s_freed_memory_goes_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: calls.append(1)))
    assert list(common.lean(lambda batches: (2 * b for b in batches))([1, 2, 3])) == [2, 4, 6] and len(calls) == 4
