"""Queries for questions, captions, figures, components and stored payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.functions import answers as A
from doclattice.functions import maths as M
from doclattice.functions import text as T
from doclattice.operators import chunking, entities, graph, grid
from doclattice.plans.base import BOXES, LINES, SECTIONS, operator
from doclattice.plans.structure_queries import MATRIX
from doclattice.sources import files
from doclattice.sources.tables import boxes, full_pages, lines, sections, table

VALID_MATRICES = f"""{MATRIX}, sz AS (SELECT doc_id, m, list_transform(m, lambda r: len(r)) AS sizes, list_filter(flatten(m), lambda c: trim(c) <> '') AS cells FROM m),
v AS (SELECT doc_id, coalesce(len(m) >= 2 AND list_max(sizes) - list_min(sizes) <= 0.4 * list_max(sizes) AND list_sum(sizes) >= 2 * len(m) AND len(cells) >= 0.25 * list_sum(sizes)
  AND len(cells) >= 4 AND list_sum(list_transform(cells, lambda c: length(c))) <= 150 * len(cells), false) AS valid FROM sz)"""


@operator(
    r"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'It is NOT found in the manual' WHEN 2 THEN 'no idea' ELSE 'See [T1] and [TABLE2].' END AS a, CASE WHEN conv_id % 5 = 0 THEN 'hello' ELSE 'Why?' END AS q, conv_id % 6 AS n FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(lower(a), 'does not contain|documentation does not|not found in|no information|not available|not specified|not mentioned|not documented|information is missing|insufficient context') THEN 'explicit_not_found'
      WHEN NOT regexp_matches(lower(q), 'hello|hi|hey|thanks|thank you') AND length(trim(a)) < 100 AND regexp_matches(lower(a), 'no|not|unable') THEN 'answer_too_short'
      WHEN n >= 3 AND len(regexp_extract_all(a, '\[(?:T|TABLE|DIAGRAM)[0-9]+\]')) <= 1 AND length(trim(a)) < 200 THEN 'low_context_usage' ELSE '' END AS reason FROM t"""
)
def r17_retry_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    a = F.when(k == 0, F.col("text")).when(k == 1, "It is NOT found in the manual").when(k == 2, "no idea").otherwise("See [T1] and [TABLE2].")
    q = F.when(F.col("conv_id") % 5 == 0, "hello").otherwise("Why?")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.retry_reason(a, q, F.col("conv_id") % 6).alias("reason"))


@operator(
    rf"""WITH {LINES} SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '\btable\s+\w+', 'i') THEN 'table' WHEN regexp_matches(line, '\b(?:figure|fig\.?|diagram|drawing|dwg\.?|schema|schematic)\s+[0-9]+', 'i') THEN 'figure' END AS kind,
      regexp_matches(line, '^\s*[0-9]+\s*$') OR (regexp_matches(lower(line), 'page|chapter|section|copyright|©|reserved') AND length(line) < 100) AS noise FROM lines"""
)
def t22_t27_p21_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", A.caption_kind(F.col("line")).alias("kind"), A.is_noise(F.col("line")).alias("noise"))


@operator(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'the main ' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'HFO check ' || p_name ELSE split_part(p_name, ' ', 2) END AS name FROM part),
    w AS (SELECT p_partkey, name, string_split(name, ' ') AS w FROM p),
    k AS (SELECT p_partkey, name, w, list_filter(w[1:len(w)-1], lambda q: list_contains(['main','hot','cold'], lower(q)) OR (upper(q) = q AND lower(q) <> q AND length(q) <= 4)) AS k FROM w)
    SELECT p_partkey, name, CASE WHEN len(w) = 1 THEN name ELSE array_to_string(list_concat(k[greatest(len(k)-2, 1):], w[len(w):]), ' ') END AS clean FROM k"""
)
def e5_clean_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("the main "), "p_name")).when(k == 1, F.col("p_name")).when(k == 2, F.concat(F.lit("HFO check "), "p_name")).otherwise(F.element_at(F.split("p_name", " "), 2))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("clean", A.clean_component(F.col("name")))


SYSTEMS = "(VALUES ('sys_ring', 'ring'), ('sys_bolt', 'bolt'), ('sys_heat', 'hot')) AS s(code, name)"


@operator(f"SELECT p_partkey, code FROM part JOIN {SYSTEMS} ON contains(lower(p_name), s.name)")
def j9_e7_e11_part_of_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component is part of the systems whose name its own holds. Systems are a stated dictionary."""
    systems = spark.sql(f"SELECT name AS keyword, code FROM {SYSTEMS}")
    return entities.dictionary_hits(table(spark, sf_dir, "part"), "p_partkey", "p_name", systems)


@operator(
    """WITH h AS (SELECT vec_id, label AS doc FROM embeddings), n AS (SELECT doc_id, source, n_chars FROM documents)
    SELECT vec_id, coalesce(source, 'label ' || doc) AS title, n_chars FROM h LEFT JOIN n ON vec_id = doc_id"""
)
def j16_p25_hydrate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("doc"))
    n = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return h.join(n, F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", F.coalesce("source", F.concat(F.lit("label "), "doc")).alias("title"), "n_chars")


@operator(
    """WITH e AS (SELECT p_partkey AS e, p_name FROM part), m AS (SELECT l_partkey AS e, l_orderkey AS o FROM lineitem)
    SELECT e.e, m.o, o_custkey AS section_id FROM e JOIN m ON e.e = m.e LEFT JOIN orders ON m.o = o_orderkey AND o_orderstatus = 'F' WHERE o_custkey IS NOT NULL"""
)
def j6_optional_then_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional sections, of which the missing ones go."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("e"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("e"), F.col("l_orderkey").alias("o"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("section_id"))
    return e.join(m, "e").join(o, "o", "left").where("section_id IS NOT NULL").select("e", "o", "section_id")


@operator(
    f"""WITH {LINES}, toc AS (SELECT doc_id, 'UNIT P-' || (100 + doc_id % 37) AS title, (doc_id % 3 + 1)::INT AS page FROM documents),
    a AS (SELECT t.doc_id, t.title, l.page, 1 AS priority FROM toc t JOIN (SELECT DISTINCT doc_id, page FROM lines) l ON t.doc_id = l.doc_id AND t.page = l.page),
    b AS (SELECT t.doc_id, t.title, l.page, 2 AS priority FROM toc t JOIN lines l ON t.doc_id = l.doc_id WHERE line_no % 10 < 15 AND contains(upper(line), t.title)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY priority, page) AS k FROM (SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)))
    SELECT doc_id, title, page, priority FROM r WHERE k = 1""".replace("contains(upper(line), t.title)", "contains(line, t.title)")
)
def j19_toc_to_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry's page is the one it names, else the first one that holds its title."""
    ls = lines(spark, sf_dir)
    d = F.col("doc_id")
    toc = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("UNIT P-"), 100 + d % 37).alias("title"), (d % 3 + 1).cast("int").alias("named"))
    hits = ls.join(toc, "doc_id").where((F.col("page") == F.col("named")) | F.contains("line", F.col("title")))
    best = hits.groupBy("doc_id", "title").agg(F.min(F.struct(F.when(F.col("page") == F.col("named"), 1).otherwise(2).alias("priority"), "page")).alias("b"))
    return best.select("doc_id", "title", "b.page", "b.priority")


@operator(
    f"""WITH {SECTIONS}, c AS (SELECT doc_id, upper(trim(title)) AS t, page_start, page_end FROM sections WHERE title <> '')
    SELECT doc_id, t AS title, min(page_start) AS start_page, max(page_end) AS end_page, count(*) AS sightings FROM c GROUP BY doc_id, t"""
)
def t13_t14_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by title: first page, and the last page of later sightings."""
    c = sections(spark, sf_dir).where("title <> ''")
    return c.groupBy("doc_id", T.upper(T.trim(F.col("title"))).alias("title")).agg(F.min("page_start").alias("start_page"), F.max("page_end").alias("end_page"), F.count(F.lit(1)).alias("sightings"))


@operator(
    f"""WITH {LINES}, p AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS content FROM lines GROUP BY ALL),
    s AS (SELECT DISTINCT doc_id, page FROM lines WHERE line_no % 7 = 0 AND line_no > 0)
    SELECT p.doc_id, p.page, length(content) AS chars FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.page = p.page) AND length(content) > 50"""
)
def t16_fallback_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    pages = ls.groupBy("doc_id", "page").agg(F.length(body).alias("chars")).where("chars > 50")
    headed = ls.where("line_no % 7 = 0 AND line_no > 0").select("doc_id", "page").distinct()
    return pages.join(headed, ["doc_id", "page"], "left_anti")


@operator(
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1.0 FIRST PART ....... 4' || chr(10) || '2.0 Second   9' || chr(10) || '2.1 Third part' || chr(10) || 'other text ' || doc_id ELSE text END AS t FROM documents),
    l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 5) AS l FROM t),
    n AS (SELECT doc_id, t, l, len(list_filter(l, lambda x: regexp_matches(x, '^[0-9]+\.?[0-9]*\s+.+[.…·\-_]{3,}\s*[0-9]+\s*$|^[0-9]+\.?[0-9]*\s+.+\s{3,}[0-9]+\s*$|^[0-9]+\.[0-9]+\s+[A-Z]'))) AS n FROM l)
    SELECT doc_id, length(t) >= 50 AND n >= 3 AND n > 0.5 * len(l) AS is_toc FROM n"""
)
def t23_toc_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = F.concat(F.lit("1.0 FIRST PART ....... 4\n2.0 Second   9\n2.1 Third part\nother text "), F.col("doc_id"))
    text = F.when(F.col("doc_id") % 3 == 0, toc).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", A.toc_share(text).alias("is_toc"))


@operator(
    """SELECT doc_id, md5(CASE WHEN length(w) > 2000 THEN left(w, 2000) || '...' ELSE w END) AS digest, length(w) AS whole FROM (
      SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 0 THEN 'Description: part ' || doc_id END, 'Caption: ' || source, 'Context: ' || text, CASE WHEN doc_id % 3 = 0 THEN 'Tags: ' || lang END) AS w FROM documents)"""
)
def t28_t29_t30_figure_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    parts = {"Description": F.when(d % 2 == 0, F.concat(F.lit("part "), d)), "Caption": F.col("source"), "Context": F.col("text"), "Tags": F.when(d % 3 == 0, F.col("lang"))}
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(A.figure_context(parts)).alias("digest"), F.length(A.figure_context(parts, 10**9)).alias("whole"))


@operator(
    f"""WITH {VALID_MATRICES}, d AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents),
    c AS (SELECT d.doc_id, valid, len(list_filter(l, lambda x: trim(x) <> '' AND len(string_split(x, ',')) >= 2)) >= 2 AS csv, CASE d.doc_id % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'TEXT' ELSE 'SCHEMA' END AS verdict, length(trim(text)) AS chars FROM d JOIN v ON d.doc_id = v.doc_id)
    SELECT doc_id, CASE WHEN valid THEN 'table from file' WHEN csv THEN 'table from model' WHEN verdict = 'TEXT' AND chars > 10 THEN 'text' WHEN verdict = 'SCHEMA' THEN 'figure' ELSE 'failed' END AS result FROM c"""
)
def t24_table_region_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a table region: the file's own table if it is valid; else what the model read as comma-separated rows; else by the model's verdict its text or a figure; else nothing.

    A document's lines stand for the region: split at spaces as read from the file, at commas as read by the model.
    """
    text = F.col("text")
    lines_of = F.split(text, "\n")
    own = chunking.valid_matrix(F.transform(lines_of, lambda x: F.split(x, " ")))
    read = F.size(F.filter(lines_of, lambda x: (F.trim(x) != "") & (F.size(F.split(x, ",")) >= 2))) >= 2
    verdict = F.pmod("doc_id", F.lit(3))
    result = F.when(own, "table from file").when(read, "table from model").when((verdict == 1) & (F.length(F.trim(text)) > 10), "text").when(verdict == 2, "figure").otherwise("failed")
    return table(spark, sf_dir, "documents").select("doc_id", result.alias("result"))


@operator(
    f"""WITH {BOXES}, f AS (SELECT * FROM boxes WHERE kind = 'figure'), t AS (SELECT * FROM boxes WHERE kind = 'table'),
    h AS (SELECT f.doc_id, f.page, f.box_id AS figure_id, t.box_id AS table_id FROM f JOIN t ON f.doc_id = t.doc_id AND f.page = t.page
      AND t.x0 >= f.x0 - (f.x1-f.x0)*0.05::DOUBLE AND t.y0 >= f.y0 - (f.y1-f.y0)*0.05::DOUBLE AND t.x1 <= f.x1 + (f.x1-f.x0)*0.05::DOUBLE AND t.y1 <= f.y1 + (f.y1-f.y0)*0.05::DOUBLE)
    SELECT f.doc_id, f.page, f.box_id AS figure_id, coalesce(string_agg(table_id, ',' ORDER BY table_id), '') AS table_ids, CASE WHEN count(table_id) > 0 THEN 'hybrid' ELSE 'figure' END AS kind
    FROM f LEFT JOIN h ON f.doc_id = h.doc_id AND f.page = h.page AND f.box_id = h.figure_id GROUP BY ALL"""
)
def t25_figures_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with the ids of the tables that lie inside of them."""
    b = boxes(spark, sf_dir)
    figures = b.where("kind = 'figure'")
    held = grid.link_by_place(figures, b.where("kind = 'table'"), crowds=full_pages(spark, sf_dir, grid.CROWD)).where("relation = 'inside'")
    ids = held.groupBy("doc_id", "page", "figure_id").agg(F.array_join(F.sort_array(F.collect_list("table_id")), ",").alias("table_ids"))
    all_figures = figures.select("doc_id", "page", F.col("box_id").alias("figure_id"))
    return all_figures.join(ids, ["doc_id", "page", "figure_id"], "left").select(
        "doc_id", "page", "figure_id", F.coalesce("table_ids", F.lit("")).alias("table_ids"), F.when(F.col("table_ids").isNotNull(), "hybrid").otherwise("figure").alias("kind")
    )


@operator(
    r"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'DIAGRAM' ELSE 'TABLE' END || chr(10) || 'Table of ' || p_name || chr(10) || 'TAGS: a, ' || p_type || ',' || chr(10) || 'k;v' || chr(10) || p_partkey || ';' || p_size AS r FROM part),
    l AS (SELECT p_partkey, string_split(r, chr(10)) AS l FROM r)
    SELECT p_partkey, l[2] AS caption, array_to_string(list_filter(list_transform(string_split(substr(l[3], 6), ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags, array_to_string(l[4:], chr(10)) AS csv FROM l WHERE l[1] = 'TABLE'"""
)
def t26_s10_model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response with its marker, caption, tags and rows."""
    head = F.when(F.col("p_partkey") % 3 == 0, "DIAGRAM").otherwise("TABLE")
    r = F.concat(head, F.lit("\nTable of "), "p_name", F.lit("\nTAGS: a, "), "p_type", F.lit(",\nk;v\n"), "p_partkey", F.lit(";"), "p_size")
    parsed = table(spark, sf_dir, "part").select("p_partkey", F.split(r, "\n").alias("l")).where(F.col("l")[0] == "TABLE")
    tags = F.filter(F.transform(F.split(F.substring(F.col("l")[2], 6, 10**6), ","), lambda t: F.trim(t)), lambda t: t != "")
    return parsed.select("p_partkey", F.col("l")[1].alias("caption"), F.array_join(tags, "|").alias("tags"), F.array_join(F.slice("l", 4, 10**6), "\n").alias("csv"))


@operator(
    """SELECT vec_id, md5(cut) AS text_key, left(cut, 500) AS text_preview, length(cut) AS char_count FROM (
      SELECT vec_id, CASE WHEN length(text) // 4 > 8000 THEN left(text, 32000) ELSE text END AS cut FROM embeddings JOIN documents ON vec_id = doc_id)"""
)
def s17_s19_s24_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id"))
    return files.vector_rows(joined, "text", "embedding").select("vec_id", "text_key", "text_preview", F.length("text").alias("char_count"))


@operator(
    """WITH d AS (SELECT doc_id, list_sort(list_distinct([source, lang, 'all'])) AS tags FROM documents) SELECT doc_id, array_to_string(tags, ',') AS tags FROM d WHERE list_has_any(tags, ['fr', 'src3'])"""
)
def p6_v7_s6_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" , ", "source", "lang", F.lit("all"), F.lit("")).alias("tags"))
    d = files.uploads(raw).withColumn("tags", F.sort_array(F.array_distinct("tags")))
    return d.where(F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("src3")))).select("doc_id", F.array_join("tags", ",").alias("tags"))


@operator(
    """WITH e AS (SELECT conv_id AS q, unnest(CASE WHEN conv_id % 3 = 0 THEN ['comp_a_b', 'eq_x'] ELSE ['sys_fuel', 'comp_pump_main_oil', 'comp_x'] END) AS code FROM (SELECT DISTINCT conv_id FROM conversations)),
    s AS (SELECT q, list_sort(list(code)) AS alls, list_sort(list(code) FILTER (code LIKE 'sys\\_%' ESCAPE '\\' OR (code LIKE 'comp\\_%' ESCAPE '\\' AND len(string_split(code, '_')) >= 4))) AS strict FROM e GROUP BY q)
    SELECT q, array_to_string(CASE WHEN strict IS NULL OR len(strict) = 0 THEN alls ELSE strict END, ',') AS codes FROM s""".replace("\\\\", "\\")
)
def p23_strict_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems, and components of four parts or more; if none is left, all."""
    q = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("q")).distinct()
    lit = lambda *x: F.array(*map(F.lit, x))
    codes = q.withColumn("codes", F.sort_array(F.when(F.col("q") % 3 == 0, lit("comp_a_b", "eq_x")).otherwise(lit("sys_fuel", "comp_pump_main_oil", "comp_x"))))
    strict = F.filter("codes", lambda c: F.startswith(c, F.lit("sys_")) | (F.startswith(c, F.lit("comp_")) & (F.size(F.split(c, "_")) >= 4)))
    return codes.select("q", F.array_join(F.when(F.size(strict) == 0, F.col("codes")).otherwise(strict), ",").alias("codes"))


@operator("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN coalesce(text, '') ELSE coalesce(split_part(text, '.', 1), '') END AS reference_context FROM conversations")
def r26_context_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("turn") % 3 != 2, F.split("text", r"\.")[0])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(first, "text", F.lit("")).alias("reference_context"))


@operator(
    f"""WITH {LINES}, p AS (SELECT doc_id, page, line_no, length(line) AS len, abs(line_no % 10 - 4) AS distance FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY distance, line_no) AS k FROM p)
    SELECT doc_id, page, line_no, distance FROM r WHERE k <= 3"""
)
def o15_o8_o17_closest_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("doc_id", "page").orderBy("distance", "line_no")
    near = lines(spark, sf_dir).withColumn("distance", F.abs(F.col("line_no") % 10 - 4))
    return near.withColumn("k", F.row_number().over(over)).where("k <= 3").select("doc_id", "page", "line_no", "distance")


@operator(
    r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<h1>')) AS h1, len(regexp_extract_all(html, 'href="')) AS n_links, len(regexp_extract_all(html, '<p>')) >= 5 AS rich FROM pages"""
)
def s2_s3_s4_page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), n("<h1>").alias("h1"), n('href="').alias("n_links"), (n("<p>") >= 5).alias("rich"))


@operator("SELECT c_custkey, upper(c_mktsegment) = c_mktsegment AND lower(c_mktsegment) <> c_mktsegment AS is_upper, regexp_matches(c_name, '[0-9]') AS has_digit, CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'plant' ELSE 'other' END AS meaning FROM customer")
def f8_f12_f31_tests_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    names = F.create_map(F.lit("BUILDING"), F.lit("house"), F.lit("MACHINERY"), F.lit("plant"))
    return table(spark, sf_dir, "customer").select("c_custkey", ((F.upper(s) == s) & (F.lower(s) != s)).alias("is_upper"), F.rlike("c_name", F.lit("[0-9]")).alias("has_digit"), F.coalesce(F.try_element_at(names, s), F.lit("other")).alias("meaning"))


@operator("SELECT event_type, count(*) AS calls, count(DISTINCT event_type || value) AS misses, round((count(*) - count(DISTINCT event_type || value)) / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY event_type".replace("event_type || value", "(value * 100)::BIGINT"))
def a22_s24_cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.round(F.col("value") * 100).cast("long")
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct(key).alias("misses"))
    return g.withColumn("hit_rate", F.round(M.ratio(F.col("calls") - F.col("misses"), F.col("calls")), 6))


@operator("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st2_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.streaming.ingest import windowed_counts

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e, "ts", "event_type", "1 day", "2 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
