"""Queries over the entity, section and table graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.functions import maths as M
from doclattice.operators import chunking, dictionary, entities, graph, grid
from doclattice.operators.small import sent
from doclattice.plans.base import BOXES, SECTIONS, operator
from doclattice.sources.tables import boxes, full_pages, sections, table

TAGGED = SECTIONS + r""",
tags AS (SELECT DISTINCT doc_id, section_no, unnest(regexp_extract_all(content, '\b([A-Z]{1,4})[-–]([0-9]{2,4}[A-Z]?)\b')) AS tag FROM sections)
"""


def section_tags(s: DataFrame, *more: str) -> DataFrame:
    return s.select("doc_id", "section_no", *more, F.explode(entities.equipment_tags(F.col("content"))).alias("t")).select("doc_id", "section_no", *more, "t.tag", "t.code", "t.kind")


def describing_sections(s: DataFrame, tags: list[str], most: int = 10) -> DataFrame:
    """Sections that describe a unit: a boost for the title times one more than the mentions; the best by importance then.

    The stated units are looked for before a section's tags are spread, and title and content travel with them: sections are read once, without a join.
    """
    from doclattice.functions import text as T

    wanted = F.filter(F.array(*map(F.lit, tags)), lambda t: F.exists(entities.equipment_tags(F.col("content")), lambda x: x["tag"] == t))
    edges = s.where(F.rlike("content", F.lit("|".join(map(re.escape, tags))))).select("doc_id", "section_no", "title", "content", F.explode(wanted).alias("tag"))
    mentions = F.size(F.split(F.lower("content"), F.concat(F.lit(r"\Q"), F.lower("tag"), F.lit(r"\E")))) - 1
    boost = F.when(F.contains(F.lower("title"), F.lower("tag")), 100).otherwise(1)
    scored = edges.withColumn("mention_count", mentions).where("mention_count > 0").withColumn("relevance", boost * (1 + F.col("mention_count"))).withColumn("importance", F.round(T.importance(F.col("content")), 6))
    return scored.select("tag", "doc_id", "section_no", "title", "mention_count", "relevance", "importance").orderBy(F.col("relevance").desc(), F.col("importance").desc(), "doc_id", "section_no", "tag").limit(most)


@operator(
    f"""WITH {TAGGED} SELECT tag, s.doc_id, s.section_no, title,
      ((length(content) - length(replace(lower(content), lower(tag), ''))) // length(tag))::INT AS mention_count,
      (CASE WHEN contains(lower(title), lower(tag)) THEN 100 ELSE 1 END * (1 + (length(content) - length(replace(lower(content), lower(tag), ''))) // length(tag)))::INT AS relevance,
      round(least(1.0, 0.5 + 0.1 * len(list_filter(['must','shall','critical','essential','mandatory','required','safety','warning','danger','emergency','caution'], lambda k: contains(lower(content), k))))::DOUBLE, 6) AS importance
    FROM tags t JOIN sections s ON t.doc_id = s.doc_id AND t.section_no = s.section_no WHERE tag IN ('P-101', 'P-117', 'P-125')
    ORDER BY relevance DESC, importance DESC, s.doc_id, s.section_no, tag LIMIT 10"""
)
def j3_o3_p24_p26_a23_sections_for_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describing_sections(sections(spark, sf_dir), ["P-101", "P-117", "P-125"])


@operator(f"WITH {TAGGED} SELECT doc_id, section_no, tag, 'eq_p_' || lower(substr(tag, 3)) AS code, 'pump' AS kind FROM tags WHERE tag LIKE 'P-%'")
def e4_equipment_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tags(sections(spark, sf_dir)).where("tag LIKE 'P-%'")


@operator(
    """SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def j1_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@operator(
    """WITH path AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 48)
    SELECT o_orderkey, o_custkey, l_linenumber, p_name FROM orders LEFT JOIN path ON o_orderkey = l_orderkey"""
)
def j2_p1_optional_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional path is joined inside first, so that it is there as a whole or not at all."""
    li, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    path = li.where("l_quantity >= 48").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")
    return o.join(path, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", "l_linenumber", "p_name")


@operator(
    """SELECT o_orderkey, count(l_orderkey) AS n_chunks, array_to_string(list_sort(list(p_name) FILTER (p_name IS NOT NULL)), '; ') AS chunks
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey"""
)
def j4_j5_a4_a16_collected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    joined = o.where("o_orderstatus = 'P'").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    names = F.sort_array(F.collect_list("p_name"))
    return joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_chunks"), F.when(F.size(names) > 0, F.array_join(names, "; ")).alias("chunks"))


@operator("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j15_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dst"))
    return graph.orphans(table(spark, sf_dir, "orders"), edges, "o_orderkey", "dst").select("o_orderkey", "o_custkey")


@operator("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1)")
def j14_j24_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "lineitem").where("l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(hit, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


EDGES = "edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@operator(
    f"""WITH RECURSIVE {EDGES}, p AS (SELECT 'c' || c_custkey AS node, 'c' || c_custkey AS ancestor, 0 AS depth FROM customer
      UNION ALL SELECT node, parent, depth + 1 FROM p JOIN edges ON ancestor = child WHERE depth < 5)
    SELECT node, arg_max(ancestor, depth) AS top, max(depth)::INT AS depth FROM p GROUP BY node"""
)
def j12_o5_e9_f24_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda k, col: F.concat(F.lit(k), F.col(col))
    edges = c.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")).unionByName(n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
    return graph.longest_path(graph.ancestors(c.select(name("c", "c_custkey").alias("k")), edges, "k"))


@operator(
    """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 50 AS dst FROM lineitem)
    SELECT src, dst FROM e UNION SELECT dst, src FROM e"""
)
def j13_u10_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.pmod("l_partkey", F.lit(50))).alias("dst"))
    return graph.both_ways(e)


@operator(
    f"""WITH {SECTIONS}, o AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS pos FROM sections),
    n AS (SELECT a.doc_id, a.section_no, b.section_no AS neighbour, row_number() OVER (PARTITION BY a.doc_id, a.section_no ORDER BY b.section_no) AS k
      FROM o a JOIN o b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 1 AND a.pos <> b.pos) SELECT doc_id, section_no, neighbour FROM n WHERE k <= 3"""
)
def j10_neighbour_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the position of sections in their document: lag and lead, without a self-join."""
    over = Window.partitionBy("doc_id").orderBy("section_no")
    s = sections(spark, sf_dir).select("doc_id", "section_no", F.array(F.lag("section_no").over(over), F.lead("section_no").over(over)).alias("near"))
    return s.select("doc_id", "section_no", F.explode("near").alias("neighbour")).where("neighbour IS NOT NULL")


CHUNKS = """chunks AS (SELECT doc_id, unnest(range(n))::INT AS idx, text FROM (SELECT doc_id, text, greatest(ceil((length(text) - 400) / 1200.0), 1)::INT AS n FROM documents)),
spans AS (SELECT doc_id, idx, idx * 1200 AS char_start, substr(text, idx * 1200 + 1, 1600) AS chunk FROM chunks)"""


@operator(f"""WITH {CHUNKS} SELECT doc_id, idx, md5(string_agg(chunk, '' ORDER BY idx) OVER (PARTITION BY doc_id ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS digest FROM spans""")
def j11_w2_v8_neighbour_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.strided_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("index", "idx")
    return graph.neighbours(chunks, ["doc_id"], "idx", "chunk").select("doc_id", "idx", F.md5(F.array_join("around", "")).alias("digest"))


@operator("SELECT doc_id, md5(text) AS digest FROM documents")
def w8_r16_overlap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks joined again are the text."""
    chunks = chunking.strided_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("char_end", F.col("char_start") + F.length("chunk"))
    return graph.trim_overlaps(chunks, ["doc_id"], "char_start", "char_end", "chunk").select("doc_id", F.md5("text").alias("digest"))


@operator(
    """WITH o AS (SELECT p_partkey AS key, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand FROM part WHERE p_partkey % 4 <> 1),
    n AS (SELECT p_partkey AS key, 'new ' || p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS brand FROM part WHERE p_partkey % 2 = 1)
    SELECT coalesce(o.key, n.key) AS key, coalesce(n.name, o.name) AS name, coalesce(n.brand, o.brand) AS brand FROM o FULL JOIN n ON o.key = n.key"""
)
def j21_m3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.where("p_partkey % 4 <> 1").select(k.alias("key"), F.col("p_name").alias("name"), F.when(k % 3 != 0, F.col("p_brand")).alias("brand"))
    new = p.where("p_partkey % 2 = 1").select(k.alias("key"), F.concat(F.lit("new "), "p_name").alias("name"), F.when(k % 5 == 0, F.col("p_brand")).alias("brand"))
    return graph.upsert(old, new, "key")


@operator(
    """WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey % 10 = 3)
    SELECT 'orders' AS node, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone))"""
)
def m1_m2_v12_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (orders) go with their chunks (lineitem), then all entities (part) that nothing mentions any more."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    gone = o.where("o_custkey % 10 = 3").select("o_orderkey")
    left = graph.without(li.withColumnRenamed("l_orderkey", "o_orderkey"), gone, "o_orderkey")
    parts = p.join(left.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    rows = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("node"), "n")
    return rows(graph.without(o, gone, "o_orderkey"), "orders").unionByName(rows(left, "lineitem")).unionByName(rows(parts, "part"))


@operator("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def m6_merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_edges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@operator(
    """SELECT (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers,
      (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitems, (SELECT count(*) FROM documents WHERE lang = 'none') AS terms"""
)
def a1_global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent counts, so that an empty table is a zero."""
    out = None
    for name, col in (("region", "regions"), ("nation", "nations"), ("customer", "customers"), ("supplier", "suppliers"), ("part", "parts"), ("orders", "orders"), ("lineitem", "lineitems"), ("documents", "terms")):
        t = table(spark, sf_dir, name)
        n = (t.where("lang = 'none'") if col == "terms" else t).agg(F.count(F.lit(1)).alias(col))
        out = n if out is None else out.crossJoin(F.broadcast(n))  # one row each
    return out


@operator(
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines, count(DISTINCT l_partkey) AS parts, count(l_partkey) AS parts_raw
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey"""
)
def a2_per_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders and distinct parts are counted by an aggregation each, so that no row is repeated for each of them."""
    o, li = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    of_orders = o.distinct().groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    lines_of = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey", "l_partkey").agg(F.count("l_orderkey").alias("n_lines"), F.count("l_partkey").alias("parts_raw"))
    of_parts = lines_of.groupBy("o_custkey").agg(F.sum("n_lines").alias("n_lines"), F.count("l_partkey").alias("parts"), F.sum("parts_raw").alias("parts_raw"))
    both = of_orders.unionByName(of_parts, allowMissingColumns=True).groupBy("o_custkey")
    return both.agg(*(F.sum(c).alias(c) for c in ("n_orders", "n_lines", "parts", "parts_raw")))


@operator(
    f"""WITH {BOXES}, p AS (SELECT f.doc_id, f.page, f.box_id AS figure_id, t.box_id AS table_id,
      t.x0 >= f.x0 - (f.x1-f.x0)*0.05::DOUBLE AND t.y0 >= f.y0 - (f.y1-f.y0)*0.05::DOUBLE AND t.x1 <= f.x1 + (f.x1-f.x0)*0.05::DOUBLE AND t.y1 <= f.y1 + (f.y1-f.y0)*0.05::DOUBLE AS held, t.y0 - f.y1 AS gap
      FROM boxes f JOIN boxes t ON f.doc_id = t.doc_id AND f.page = t.page WHERE f.kind = 'figure' AND t.kind = 'table')
    SELECT doc_id, page, figure_id, table_id, CASE WHEN held THEN 'inside' ELSE 'below' END AS relation FROM p WHERE held OR (gap > 0 AND gap < 150)"""
)
def j7_m5_figures_to_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return grid.link_by_place(b.where("kind = 'figure'"), b.where("kind = 'table'"), crowds=full_pages(spark, sf_dir, grid.CROWD))


@operator(
    f"""WITH {BOXES}, p AS (SELECT f.doc_id, f.page, f.box_id AS figure_id, c.box_id AS caption_id,
      greatest(c.y0 - f.y1, f.y0 - c.y1, 0) + 2 * greatest(c.x0 - f.x1, f.x0 - c.x1, 0) AS distance FROM boxes f JOIN boxes c ON f.doc_id = c.doc_id AND f.page = c.page
      WHERE f.kind = 'figure' AND c.kind = 'table'),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, figure_id ORDER BY distance, caption_id) AS k FROM p WHERE distance < 100)
    SELECT doc_id, page, figure_id, caption_id, distance FROM r WHERE k = 1"""
)
def j17_t22_nearest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return grid.nearest_caption(b.where("kind = 'figure'"), b.where("kind = 'table'"), crowds=full_pages(spark, sf_dir, grid.CROWD))


@operator(
    f"""WITH {BOXES} SELECT a.box_id AS a, b.box_id AS b, round(CASE WHEN least(a.x1,b.x1) > greatest(a.x0,b.x0) AND least(a.y1,b.y1) > greatest(a.y0,b.y0) THEN
      (least(a.x1,b.x1) - greatest(a.x0,b.x0)) * (least(a.y1,b.y1) - greatest(a.y0,b.y0)) / ((a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) - (least(a.x1,b.x1) - greatest(a.x0,b.x0)) * (least(a.y1,b.y1) - greatest(a.y0,b.y0))) ELSE 0 END, 6) AS iou,
      round(sqrt(((a.x0+a.x1)/2 - (b.x0+b.x1)/2)**2 + ((a.y0+a.y1)/2 - (b.y0+b.y1)/2)**2), 6) AS distance
    FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.box_id < b.box_id"""
)
def f18_f19_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("doc_id", "page", "box_id", "box")
    pairs = b.alias("a").join(b.alias("b"), ["doc_id", "page"]).where("a.box_id < b.box_id")
    return pairs.select(F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), F.round(M.iou(F.col("a.box"), F.col("b.box")), 6).alias("iou"), F.round(M.centre_distance(F.col("a.box"), F.col("b.box")), 6).alias("distance"))


@operator(f"WITH {BOXES} SELECT box_id, kind, conf FROM boxes WHERE (kind = 'table' AND conf >= 0.04::DOUBLE OR kind = 'figure' AND conf >= 0.01::DOUBLE) AND x1 - x0 >= 80 AND y1 - y0 >= 80 AND (x1-x0)*(y1-y0) / 480000.0::DOUBLE >= 0.02::DOUBLE")
def p19_p20_t20_region_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    sure = F.when(F.col("kind") == "table", F.col("conf") >= 0.04).otherwise(F.col("conf") >= 0.01)
    return boxes(spark, sf_dir).where(sure & (w >= 80) & (h >= 80) & (M.area(F.col("box")) / 480000.0 >= 0.02)).select("box_id", "kind", "conf")


@operator(
    f"""WITH {BOXES}, n AS (SELECT *, sum((kind = 'figure')::INT) OVER (PARTITION BY doc_id, page) AS figs, row_number() OVER (PARTITION BY doc_id, page ORDER BY box_id) AS k FROM boxes)
    SELECT box_id, CASE WHEN k % 4 = 0 THEN 'TEXT' WHEN kind = 'table' AND conf >= 0.08::DOUBLE THEN 'TABLE' WHEN kind = 'figure' AND conf >= 0.05::DOUBLE THEN 'SCHEMA' ELSE CASE WHEN figs > 1 THEN 'SCHEMA' ELSE 'TABLE' END END AS region_type FROM n"""
)
def t21_region_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of rules: contents pages are text, sure detections stay, the joined verdict decides the rest."""
    page = Window.partitionBy("doc_id", "page")
    b = boxes(spark, sf_dir).withColumn("figs", F.sum((F.col("kind") == "figure").cast("int")).over(page)).withColumn("k", F.row_number().over(page.orderBy("box_id")))
    verdict = F.when(F.col("figs") > 1, "SCHEMA").otherwise("TABLE")
    kind = F.when(F.col("k") % 4 == 0, "TEXT").when((F.col("kind") == "table") & (F.col("conf") >= 0.08), "TABLE").when((F.col("kind") == "figure") & (F.col("conf") >= 0.05), "SCHEMA").otherwise(verdict)
    return b.select("box_id", kind.alias("region_type"))


@operator()
def t6_keep_first_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).where("kind = 'table'").select("doc_id", "page", "box_id", "box.*")
    return grid.keep_first(b, ["doc_id", "page"], "box_id", 0.3).select("doc_id", "page", "box_id")


DICTIONARY = "(VALUES ('ring', 'sys_ring'), ('bolt', 'sys_fastener'), ('gear', 'sys_drive'), ('rod', 'sys_drive'), ('hot', 'sys_heat')) AS d(keyword, code)"


@operator(f"SELECT DISTINCT p_partkey, code FROM part JOIN {DICTIONARY} ON contains(lower(p_name), keyword)")
def e1_e2_p8_system_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.sql(f"SELECT * FROM {DICTIONARY.replace(' AS d(', ' AS d(')}")
    return entities.dictionary_hits(table(spark, sf_dir, "part"), "p_partkey", "p_name", words)


@operator("SELECT p_partkey, left('comp_' || split_part(p_name, ' ', 2) || '_' || replace(lower(p_name), ' ', '_'), 40) AS code FROM part")
def e6_component_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", entities.component_code(F.element_at(F.split("p_name", " "), 2), F.col("p_name")).alias("code"))


COMPONENTS = [("ring", "ring"), ("bolt", "bolt"), ("gear", "gear"), ("rod", "rod")]


def component_texts(parts: DataFrame) -> DataFrame:
    """A text of two components for each part."""
    return parts.select("p_partkey", F.concat(F.lit("Check the main "), "p_name", F.lit(" and then the HFO "), "p_name", F.lit("s of it")).alias("text"))


@operator()
def e3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in texts made of part names, cleaned of words that are no qualifiers."""
    found = entities.components(COMPONENTS)
    return component_texts(table(spark, sf_dir, "part")).select("p_partkey", F.explode(found("text")).alias("c")).select("p_partkey", "c.*")


@operator(
    """WITH p AS (SELECT DISTINCT p_brand AS name FROM part), n AS (SELECT unnest(['Brand#1', 'brand#2', 'D#3']) AS wanted)
    SELECT wanted, name FROM n JOIN p ON contains(lower(name), lower(wanted))"""
)
def j25_p9_p10_find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sql("SELECT explode(array('Brand#1', 'brand#2', 'D#3')) AS wanted")
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.join(F.broadcast(wanted), F.contains(F.lower("name"), F.lower("wanted"))).select("wanted", "name")


@operator(
    """WITH n AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part)), w AS (SELECT DISTINCT wanted FROM (SELECT unnest(string_split(upper(p_name), ' ')) AS wanted FROM part UNION ALL SELECT left(p_brand, 7) FROM part)),
    r AS (SELECT wanted, name, row_number() OVER (PARTITION BY wanted ORDER BY length(name), name) AS k FROM w JOIN n ON contains(lower(name), lower(wanted))) SELECT wanted, name, k FROM r WHERE k <= 10"""
)
def j25_p8_o6_all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten shortest names that hold each word of a name or beginning of a brand."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).union(part.select("p_brand")).distinct()
    wanted = part.select(F.explode(F.split(F.upper("p_name"), " ")).alias("wanted")).union(part.select(F.left("p_brand", F.lit(7)))).distinct()
    lowered = names.select("name", F.lower("name").alias("low"))
    hits = dictionary.keyword_hits(lowered, "name", "low", wanted.select(F.lower("wanted").alias("keyword")))
    found = hits.join(sent(wanted.withColumn("keyword", F.lower("wanted"))), "keyword").select("wanted", "name")
    over = Window.partitionBy("wanted").orderBy(F.length("name"), "name")
    return found.withColumn("k", F.row_number().over(over)).where("k <= 10")


@operator(
    """WITH b AS (SELECT p_partkey, p_name, p_type FROM part), one AS (SELECT p_partkey, p_name, 1 AS priority FROM b WHERE contains(p_name, 'hot') ORDER BY p_partkey LIMIT 10),
    two AS (SELECT p_partkey, p_name, 2 AS priority FROM b WHERE p_name LIKE 'cold%' ORDER BY p_partkey LIMIT 10), three AS (SELECT p_partkey, p_name, 3 AS priority FROM b WHERE p_type = 'SMALL' ORDER BY length(p_name), p_partkey LIMIT 10),
    u AS (SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three) SELECT * FROM u ORDER BY priority, p_name, p_partkey LIMIT 25"""
)
def u1_o4_o6_union_of_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    branch = lambda where, order, k: p.where(where).orderBy(*order).limit(10).select("p_partkey", "p_name", F.lit(k).alias("priority"))
    one, two = branch(F.contains("p_name", F.lit("hot")), ["p_partkey"], 1), branch(F.startswith("p_name", F.lit("cold")), ["p_partkey"], 2)
    three = branch(F.col("p_type") == "SMALL", [F.length("p_name"), "p_partkey"], 3)
    return one.union(two).union(three).distinct().orderBy("priority", "p_name", "p_partkey").limit(25)


@operator(
    """SELECT DISTINCT v FROM (SELECT lower(p_name) AS v FROM part WHERE length(p_name) > 2 UNION ALL SELECT p_brand FROM part WHERE trim(p_brand) <> '')"""
)
def a21_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(F.length("p_name") > 2).select(F.lower("p_name").alias("v")).union(p.where(F.trim("p_brand") != "").select("p_brand")).distinct().orderBy("v")


@operator(
    """WITH q AS (SELECT unnest(range(5)) AS q, unnest(['why is the small ring hot', 'large bolt and red gear', 'nothing here', 'BLUE BOLT', 'old rod P-101']) AS question),
    v AS (SELECT DISTINCT lower(p_name) AS name FROM part), m AS (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY length(name) DESC, name) AS k FROM q JOIN v ON contains(lower(question), name))
    SELECT q, name FROM m WHERE k <= 5"""
)
def e12_o14_entities_in_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions are few and stated; they go to the vocabulary."""
    q = spark.sql("SELECT posexplode(array('why is the small ring hot', 'large bolt and red gear', 'nothing here', 'BLUE BOLT', 'old rod P-101')) AS (q, question)")
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    hits = names.join(F.broadcast(q), F.contains(F.lower("question"), F.col("name")))
    over = Window.partitionBy("q").orderBy(F.length("name").desc(), "name")
    return hits.withColumn("k", F.row_number().over(over)).where("k <= 5").select("q", "name")


# Questions that name a part, its brand, a general word and a code, made of every user turn.
QUESTIONS = """questions AS (SELECT conv_id || '-' || turn AS q, c.text || ' Is the ' || p_name || ' near valve HGM-' || (conv_id % 90) || ' or ' || upper(p_brand) || '?' AS question
    FROM conversations c JOIN part ON p_partkey = (SELECT min(p_partkey) FROM part) + (conv_id * 31 + turn) % (SELECT count(*) FROM part) WHERE role = 'user'),
names AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT upper(p_type) FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part UNION ALL SELECT 'Valve'))"""
GENERAL_SQL = ", ".join(f"'{g}'" for g in entities.GENERAL)


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    of = part.agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("parts"))  # one row
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").crossJoin(F.broadcast(of)).withColumn("p_partkey", F.col("first") + (F.col("conv_id") * 31 + F.col("turn")) % F.col("parts"))
    code = F.concat(F.lit(" near valve HGM-"), F.col("conv_id") % 90, F.lit(" or "), F.upper("p_brand"), F.lit("?"))
    return asked.join(part, "p_partkey").select(F.concat_ws("-", "conv_id", "turn").alias("q"), F.concat("text", F.lit(" Is the "), "p_name", code).alias("question"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.array("p_name", "p_brand", F.upper("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("Valve"))).alias("name")).distinct()


@operator(
    rf"""WITH {QUESTIONS}, known AS (SELECT lower(name) AS low, min(name) AS name FROM names WHERE length(name) >= 3 AND lower(name) NOT IN ({GENERAL_SQL})
      AND (regexp_matches(name, '[ -]') OR (upper(name) = name AND lower(name) <> name) OR regexp_matches(name, '[0-9]') OR length(name) > 8) GROUP BY 1),
    codes AS (SELECT q, unnest(c) AS name, unnest(range(len(c))) AS place FROM (SELECT q, regexp_extract_all(question, '\b([A-Z]{{1,4}}[-]?[0-9]{{1,5}})\b', 1) AS c FROM questions)),
    found AS (SELECT q, low, name, 0 AS kind, 0 AS place FROM questions JOIN known ON contains(lower(question), low) UNION ALL SELECT q, lower(name), name, 1, place FROM codes),
    firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY q, low ORDER BY kind, place, name) = 1)
    SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY length(name) DESC, kind, place, name) AS k FROM firsts QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(name) DESC, kind, place, name) <= 5"""
)
def e12_o14_names_in_all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, against all names of parts, brands and types: the five longest names and codes."""
    return entities.question_entities(part_questions(spark, sf_dir), "q", "question", part_names(spark, sf_dir))


@operator(
    f"""WITH {QUESTIONS}, d AS (SELECT DISTINCT lower(p_name) AS keyword, 'sys_' || split_part(lower(p_name), ' ', 2) AS code FROM part UNION SELECT DISTINCT lower(p_brand), 'brand_' || right(p_brand, 2) FROM part)
    SELECT DISTINCT q, code FROM questions JOIN d ON contains(lower(question), keyword)"""
)
def e2_e7_p8_systems_of_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The systems that user turns name, by a dictionary of all parts and brands."""
    part, low = table(spark, sf_dir, "part"), F.lower("p_name")
    d = part.select(low.alias("keyword"), F.concat(F.lit("sys_"), F.split_part(low, F.lit(" "), F.lit(2))).alias("code")).union(part.select(F.lower("p_brand"), F.concat(F.lit("brand_"), F.right("p_brand", F.lit(2))))).distinct()
    return entities.dictionary_hits(part_questions(spark, sf_dir), "q", "question", d)


@operator(
    f"""WITH {SECTIONS}, r AS (SELECT DISTINCT doc_id, section_no, unnest(regexp_extract_all(content, '(?:Figure|Fig\\.)\\s*([0-9]+)', 1)) AS number FROM sections WHERE contains(content, 'Figure') OR contains(content, 'Fig.')),
    f AS (SELECT doc_id, 'fig-' || doc_id || '-' || (doc_id % 9) AS figure_id, 'Figure ' || (doc_id % 9) || ' of unit' AS caption FROM documents),
    m AS (SELECT r.doc_id, section_no, number, figure_id, row_number() OVER (PARTITION BY r.doc_id, section_no, number ORDER BY figure_id) AS k FROM r JOIN f ON r.doc_id = f.doc_id AND contains(caption, number))
    SELECT doc_id, section_no, number, figure_id FROM m WHERE k = 1"""
)
def j8_p12_cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = sections(spark, sf_dir).where(F.contains("content", F.lit("Figure")) | F.contains("content", F.lit("Fig.")))
    refs = refs.select("doc_id", "section_no", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:Figure|Fig\.)\s*([0-9]+)"), F.lit(1)))).alias("number"))
    d = F.col("doc_id")
    k = F.pmod(d, F.lit(9))
    figures = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", F.lit("fig"), d, k).alias("figure_id"), F.concat(F.lit("Figure "), k, F.lit(" of unit")).alias("caption"))
    hits = refs.join(figures, "doc_id").where(F.contains("caption", F.col("number")))
    return hits.groupBy("doc_id", "section_no", "number").agg(F.min("figure_id").alias("figure_id"))


@operator("SELECT event_id, user_id, event_type, regexp_extract(props, '\"k\": ([0-9]+)', 1)::INT AS k, coalesce(value, 0) AS value FROM events WHERE event_type IN ('click', 'error') AND user_id = 7")
def p2_p3_p7_f25_payload_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters apply only if given; an empty value is none."""
    from doclattice.operators.filters import payload_filter

    e = payload_filter(table(spark, sf_dir, "events"), equal={"user_id": 7, "props": ""}, among={"event_type": ["click", "error"], "event_id": []})
    return e.select("event_id", "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))
