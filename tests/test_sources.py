import json

import pytest
from pyspark.sql import functions as F

from doclattice.functions import answers as A
from doclattice.sources import files
from doclattice.sources.objects import ObjectStore, ensure_tables
from doclattice.streaming import ingest


def test_binary_files_and_dictionary(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    got = files.binary_files(spark, str(tmp_path / "*.bin")).collect()
    assert got[0].length == 3 and got[0].file_hash.startswith("ba7816bf")
    spec = {"systems": {"fuel": {"code": "sys_fuel", "canonical": "Fuel", "keywords": ["HFO"], "aliases": None, "abbreviations": ["FO"], "parent": None}, "air": {"canonical": "Air", "keywords": []}}, "components": {}}
    (tmp_path / "d.json").write_text(json.dumps(spec))
    assert {(r.keyword, r.code) for r in files.dictionary(spark, str(tmp_path / "d.json")).collect()} == {("fuel", "sys_fuel"), ("hfo", "sys_fuel"), ("air", "sys_air")}


def test_evaluation_and_results(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"question": "q", "answer": {"answer_text": "a", "citations": [{"doc_title": "d", "page": "3"}], "figures": [], "tables": []}, "expected_type": {"primary_type": "text", "expected_tools": ["t"]}}]))
    r = files.evaluation(spark, str(tmp_path / "e.json")).first()
    assert r.answer.citations[0].page == "3" and r.expected_type.primary_type == "text"
    files.write_results(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_csv_text_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([([["a  b", None], ["c", "d"]],)], "m array<array<string>>")
    assert df.select(files.csv_text(F.col("m"))).first()[0] == "﻿a b,\nc,d"
    path = str(tmp_path / "p")
    files.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "doc int, x string"), path, "doc")
    files.replace_partition(spark.createDataFrame([(2, "c")], "doc int, x string"), path, "doc")
    assert {(r.doc, r.x) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_vector_rows(spark):
    df = spark.createDataFrame([("x" * 40000, [1.0, 0.0]), ("y", [0.0, 0.0])], "text string, v array<float>")
    got = files.vector_rows(df, "text", "v").collect()
    assert len(got) == 1 and len(got[0].text) == 32000 and len(got[0].text_preview) == 500


def test_file_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\n2\n3")
    ingest.ingest(spark, source, target, state).awaitTermination(120)
    (tmp_path / "in" / "b.txt").write_text("1")
    ingest.ingest(spark, source, target, state).awaitTermination(120)
    assert sorted(r.n_lines for r in spark.read.parquet(target).collect()) == [1, 3]


def test_captions_and_noise(spark):
    rows = [("Table 3: flows",), ("Fig. 4 pump",), ("<< FIG. S-03 >>",), ("none here",), (" 12 ",), ("Page 4 of 7",)]
    got = spark.createDataFrame(rows, "t string").select(A.caption_kind(F.col("t")).alias("k"), A.is_noise(F.col("t")).alias("n")).collect()
    assert [r.k for r in got] == ["table", "figure", "figure", None, None, None] and [r.n for r in got] == [False] * 4 + [True] * 2


def test_missing_dictionary_is_empty(spark, tmp_path):
    assert files.dictionary(spark, str(tmp_path / "none.json")).collect() == []


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "store"), wait=0.01)
    assert store.save("a/b.bin", bytes(range(256))).endswith("/store/a/b.bin")
    assert store.get("a/b.bin") == bytes(range(256)) and store.exists("a/b.bin")
    store.save("a/b.bin", b"")
    assert store.get("a/b.bin") == b"" and store.delete("a/b.bin") and not store.exists("a/b.bin") and not store.delete("a/b.bin")
    for key in ("", "/etc/passwd", "a/../../b"):
        with pytest.raises(ValueError):
            store.get(key)


def test_object_store_tries_again(spark, tmp_path):
    store, calls = ObjectStore(spark, str(tmp_path), wait=0.01), []

    def act():
        calls.append(1)
        return store.jvm.java.lang.Integer.parseInt("7" if len(calls) == 3 else "x")

    assert store.again(act) == 7 and len(calls) == 3
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound"):
        store.get("nothing here")


def test_tables_are_made_where_missing(spark):
    assert ensure_tables(spark, {"made_here": "a int, b string"}) == ["made_here"] and ensure_tables(spark, {"made_here": "a int, b string"}) == []
    spark.sql("DROP TABLE made_here")
