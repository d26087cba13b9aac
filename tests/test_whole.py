"""That queries and operators take whole tables and texts."""

import pytest
from pyspark.sql import functions as F

from doclattice.operators import search
from doclattice.plans import registry


def test_vector_search_asks_for_every_hundredth_row(spark, sf_dir):
    got = registry.queries()["v1_v2_v3_o1_p5_vector_search"](spark, sf_dir)
    assert sorted(r.q_id for r in got.select("q_id").distinct().collect()) == [0, 100, 200, 300, 400]


@pytest.mark.parametrize("block", [1, 7])
def test_top_k_in_blocks(spark, sf_dir, block):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("p"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("p").alias("q"))
    whole = search.top_k(q, e, 5, 0.1, "q_id", "vec_id").collect()
    assert {r.q_id for r in whole} == set(range(0, 500, 50)) and sorted(search.top_k(q, e, 5, 0.1, "q_id", "vec_id", blocks=(block, block)).collect()) == sorted(whole)


def test_table_chunks_hold_whole_lines(spark, tmp_path):
    lines = [" ".join(f"c{i}x{j}" for j in range(300)) for i in range(3)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["t3_t5_table_chunks"](spark, str(tmp_path)).collect()
    assert [r.text_length for r in got] == [len("\n".join(x.replace(" ", " | ") for x in lines))]


def test_whole_texts_decide(spark, tmp_path):
    far = "x" * 400 + " "
    toc = "\n".join(["pad words " * 40] + [f"{i}.0 Part of it ..... {i}" for i in range(1, 9)])
    rows = [(1, far + "the end"), (2, toc), (4, "\n".join([" ".join(["word"] * 40), " ".join(["word"] * 23)]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ask = lambda name: {r.doc_id: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert ask("t23_toc_regions")[2].is_toc
    assert ask("f1_f16_text_functions")[1].clean == far + "the end"
    assert ask("p17_valid_tables")[4].valid is False


def test_whole_tables_are_counted(spark, sf_dir):
    ask = lambda name: registry.queries()[name](spark, sf_dir)
    size = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    assert ask("t24_table_region_chain").count() == size("documents")
    assert ask("j16_p25_hydrate_hits").count() == size("embeddings")
    assert {r.q for r in ask("r15_a9_document_boost").select("q").distinct().collect()} == set(range(0, size("embeddings"), 100))
    assert ask("t31_table_nodes_and_chunks").select("doc_id").distinct().count() == 50
    assert {0, 1, 2, 3} <= {r.line_no for r in ask("t22_t27_p21_captions").select("line_no").distinct().collect()}
