"""Queries over files, objects and streams: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.plans.base import operator
from doclattice.sources import files, objects
from doclattice.sources.objects import ensure_tables
from doclattice.sources.tables import table
from doclattice.streaming import ingest


@operator(
    """WITH p AS (SELECT lower(p_name) AS name, split_part(lower(p_name), ' ', 2) AS noun FROM part)
    SELECT DISTINCT name AS keyword, 'sys_' || noun AS code FROM p UNION SELECT noun, 'sys_' || noun FROM p UNION SELECT 'all ' || noun || 's', 'sys_' || noun FROM p UNION SELECT 'missing files', '0'"""
)
def s7_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary file of systems, one for each noun of the parts' names, read back; and how many entries a file has that isn't there."""
    folder, noun = files.scratch(spark), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2))
    systems = table(spark, sf_dir, "part").groupBy(noun.alias("noun")).agg(F.sort_array(F.collect_set(F.upper("p_name"))).alias("keywords"))
    entry = F.struct(
        F.concat(F.lit("sys_"), "noun").alias("code"), F.initcap("noun").alias("canonical"), "keywords", F.array(F.concat(F.lit("All "), "noun", F.lit("s"))).alias("aliases")
    )
    # A dictionary is one file, as what reads it expects one: names of parts repeat, so it has few.
    whole = systems.agg(F.map_from_entries(F.collect_list(F.struct("noun", entry))).alias("systems"))
    whole.select(F.to_json(F.struct("systems")).alias("value")).coalesce(1).write.text(folder)
    missing = files.dictionary(spark, f"{folder}/none.json").agg(F.lit("missing files").alias("keyword"), F.count(F.lit(1)).cast("string").alias("code"))
    return files.dictionary(spark, folder).unionByName(missing)


@operator(
    """SELECT 'q' || item_id AS question, text AS answer_text, 1 AS citations, CASE WHEN item_id % 2 = 0 THEN 'text' ELSE 'table' END AS primary_type, item_id % 7 AS page FROM benchmark"""
)
def s8_evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with expected answers, written as JSON and read by their schema."""
    folder, i = files.scratch(spark), F.col("item_id")
    cited = F.array(F.struct(F.lit("d").alias("doc_title"), (i % 7).cast("string").alias("page")))
    rows = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), i).alias("question"), F.struct(F.col("text").alias("answer_text"), cited.alias("citations")).alias("answer"),
        F.struct(F.when(i % 2 == 0, "text").otherwise("table").alias("primary_type")).alias("expected_type"),
    )
    rows.write.json(folder)
    e = files.evaluation(spark, folder, whole=False)
    return e.select("question", "answer.answer_text", F.size("answer.citations").alias("citations"), "expected_type.primary_type", F.get("answer.citations", F.lit(0))["page"].cast("long").alias("page"))


@operator("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def s21_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as one JSON file."""
    folder = files.scratch(spark)
    files.write_results(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")), folder)
    return spark.read.schema("event_type string, n long, mean double").json(folder)


@operator(
    """SELECT page_id, strlen(coalesce(html, '')) AS bytes, md5(coalesce(html, '')) AS digest, page_id % 3 = 0 AS deleted, page_id % 3 <> 0 AS there FROM pages"""
)
def s12_object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's html as an object, written and read by tasks; a third of them deleted, and what is there after that."""
    root, key = files.scratch(spark), F.concat_ws("/", F.lit("pages"), F.pmod(F.col("page_id"), F.lit(16)), F.concat(F.col("page_id"), F.lit(".html")))
    rows = table(spark, sf_dir, "pages").select("page_id", key.alias("key"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("data"))
    saved = files.written(objects.save_all(rows, root))
    read = files.written(objects.read_all(spark, root).select("key", F.md5("content").alias("digest")))
    gone = files.written(objects.delete_all(rows.where("page_id % 3 = 0").select("key"), root))
    there = objects.read_all(spark, root).select("key", F.lit(True).alias("there"))
    found = rows.select("page_id", "key").join(saved, "key").join(read, "key").join(gone, "key", "left").join(there, "key", "left")
    return found.select("page_id", "bytes", "digest", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("there", F.lit(False)).alias("there"))


COLLECTIONS = {
    "doclattice_text_chunks": "chunk_id string, doc_id string, vector array<float>",
    "doclattice_table_chunks": "chunk_id string, table_id string, doc_id string, vector array<float>",
    "doclattice_figures": "figure_id string, doc_id string, vector array<float>",
}


@operator(
    """SELECT CASE vec_id % 3 WHEN 0 THEN 'doclattice_text_chunks' WHEN 1 THEN 'doclattice_table_chunks' ELSE 'doclattice_figures' END AS name, count(*) AS rows, count(DISTINCT label) AS documents, 0 AS made_again FROM embeddings GROUP BY 1"""
)
def s18_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables for vectors, made where they are missing and filled with all embeddings by kind; a second call makes none."""
    ensure_tables(spark, COLLECTIONS)
    again, e, found = ensure_tables(spark, COLLECTIONS), table(spark, sf_dir, "embeddings"), None
    for k, name in enumerate(COLLECTIONS):
        own = e.where(F.col("vec_id") % 3 == k).select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("vector"))
        columns = [F.col("id") if c.endswith("_id") and c != "doc_id" else F.col(c) for c in spark.table(name).columns]
        own.select(*columns).write.insertInto(name, overwrite=True)
        held = spark.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("documents"), F.lit(int(name in again)).alias("made_again"))
        found = held if found is None else found.unionByName(held)
    return found


@operator("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")
def st2_ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, each read once: a second run over the same checkpoint adds nothing."""
    folder, schema = files.scratch(spark), table(spark, sf_dir, "events").schema
    for _ in range(2):
        ingest.append_new(ingest.table_stream(spark, sf_dir, "events.parquet", schema), f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))
