"""Queries for vector and full-text search, answering, evaluation, storage and request limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.functions import maths as M
from doclattice.functions import text as T
from doclattice.operators import attribution, cells, filters, order_statistics, search
from doclattice.plans.base import operator
from doclattice.plans.graph_queries import TAGGED, section_tags
from doclattice.sources import files
from doclattice.sources.tables import sections, table
from doclattice.streaming import rate_limit

COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def nearest(e: DataFrame, asked: str) -> DataFrame:
    """The ten nearest rows of each row that is asked for."""
    q = e.where(asked).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    return search.top_k(q, e.select("vec_id", "label", F.col("embedding").alias("p")), 10, 0.1, "q_id", "vec_id").withColumn("score", F.round("score", 6))


@operator(
    f"""WITH r AS (SELECT a.vec_id AS q_id, b.vec_id, b.label, {COS} AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM r WHERE score >= 0.1) SELECT q_id, vec_id, label, round(score, 6) AS score, rank FROM k WHERE rank <= 10"""
)
def v1_v2_v3_o1_p5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    return nearest(points(spark, sf_dir), "vec_id % 100 = 0")


@operator(
    f"""WITH r AS (SELECT a.vec_id AS q_id, {COS} AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0),
    k AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC) AS rank FROM r WHERE score >= 0.1)
    SELECT q_id, count(*) AS neighbours, true AS found, true AS exact_scores FROM k WHERE rank <= 10 GROUP BY q_id"""
)
def v1_o1_cell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100, asked of an index of cells of all rows and of all rows: the neighbours, whether the index finds nine tenths of all of these, and whether its scores are theirs."""
    e = points(spark, sf_dir)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    index = cells.build(e.select("vec_id", "embedding"), "vec_id", "embedding", files.scratch(spark))
    found = index.search(q, 10, 0.1, "q_id").select("q_id", "vec_id", F.col("score").alias("of_index"))
    exact = search.top_k(q, e.select("vec_id", F.col("embedding").alias("p")), 10, 0.1, "q_id", "vec_id")
    both = exact.join(found, ["q_id", "vec_id"], "left").groupBy("q_id").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("of_index").alias("held"), F.coalesce(F.max(F.abs(F.col("score") - F.col("of_index"))) < 1e-9, F.lit(True)).alias("exact_scores")
    )
    share = both.agg((F.sum("held") >= 0.9 * F.sum("neighbours")).alias("found"))  # one row
    return both.crossJoin(F.broadcast(share)).select("q_id", "neighbours", "found", "exact_scores")


@operator(
    """WITH e AS (SELECT vec_id // 5 AS section, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT section, i::INT AS i, round(avg(x), 6) AS x FROM e GROUP BY section, i"""
)
def a6_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = search.mean_vectors(points(spark, sf_dir).withColumn("section", F.floor(F.col("vec_id") / 5)), ["section"], "embedding")
    return m.select("section", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


LINKS = """c AS (SELECT label AS doc, vec_id // 5 AS section, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    x AS (SELECT doc, section, unnest(range(64)) AS i, unnest(v) AS x FROM c), m AS (SELECT doc, section, i, avg(x) AS x FROM x GROUP BY ALL),
    mv AS (SELECT doc, section, list(x ORDER BY i) AS v FROM m GROUP BY ALL),
    p AS (SELECT mv.doc, mv.section AS source, c.section AS target, c.vec_id, list_cosine_similarity(mv.v, c.v) AS score FROM mv JOIN c ON mv.doc = c.doc AND mv.section <> c.section),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc, source ORDER BY score DESC, vec_id) AS k FROM p QUALIFY k <= 15),
    f AS (SELECT doc, source, target, max(score) AS score FROM t GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY doc, source ORDER BY score DESC, target) AS k FROM f WHERE score >= 0.2),
    links AS (SELECT doc, source, target, score FROM g WHERE k <= 5)"""


def section_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors against the chunks of other sections of the document: the best 3k chunks, then the first of each section, then k."""
    c = points(spark, sf_dir).select(F.col("label").alias("doc"), F.floor(F.col("vec_id") / 5).alias("section"), "vec_id", "embedding")
    m = search.mean_vectors(c, ["doc", "section"], "embedding").select("doc", F.col("section").alias("source"), "section", F.col("embedding").alias("q"))
    top = search.top_by_blocks(m, c.select("doc", "section", "vec_id", F.col("embedding").alias("p")), "doc", "source", "section", "vec_id", 15)
    first = top.groupBy("doc", "source", F.col("of_section").alias("target")).agg(F.max("score").alias("score")).where("score >= 0.2")
    by = Window.partitionBy("doc", "source").orderBy(F.col("score").desc(), "target")
    return first.withColumn("k", F.row_number().over(by)).where("k <= 5").drop("k")


@operator(f"WITH {LINKS} SELECT doc, source, target, round(score, 6) AS score FROM links")
def v4_j20_w1_p4_section_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_links(spark, sf_dir).withColumn("score", F.round("score", 6))


@operator(
    f"""WITH {LINKS}, s AS (SELECT DISTINCT doc, section FROM c)
    SELECT s.doc, count(DISTINCT section) AS sections, count(target) AS links, round(avg(score), 6) AS mean_score, round(CASE WHEN count(DISTINCT section) > 0 THEN count(target) / count(DISTINCT section)::DOUBLE ELSE 0 END, 6) AS links_per_section
    FROM s LEFT JOIN links l ON s.doc = l.doc AND s.section = l.source GROUP BY s.doc"""
)
def a3_similarity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a document, the links that section similarity gives them, and their mean score."""
    n = points(spark, sf_dir).select(F.col("label").alias("doc"), F.floor(F.col("vec_id") / 5).alias("section")).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("sections"))
    found = section_links(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("found"), F.avg("score").alias("mean"))
    links = F.coalesce("found", F.lit(0))
    return n.join(found, "doc", "left").select("doc", "sections", links.alias("links"), F.round("mean", 6).alias("mean_score"), F.round(M.ratio(links, F.col("sections")), 6).alias("links_per_section"))


QUERY = ["the", "and", "reer", "thanst", "plant"]
BM25 = f"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS length, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(QUERY))} FROM tok),
g AS (SELECT count(*) AS n, avg(length) AS mean, {', '.join(f'sum((tf{i} > 0)::INT) AS df{i}' for i in range(len(QUERY)))} FROM s),
bm AS (SELECT doc_id, {' + '.join(f'ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))' for i in range(len(QUERY)))} AS score FROM s, g)"""


@operator(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def v9_v10_o2_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY)
    return hits.orderBy(F.round("score", 9).desc(), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@operator(
    f"""WITH {TAGGED}, {BM25}, c AS (SELECT doc_id, count(*) AS relevance FROM tags WHERE tag IN ('P-101', 'P-117', 'P-125') GROUP BY doc_id),
    s AS (SELECT doc_id, score FROM bm JOIN c USING (doc_id) WHERE score >= 0.5), five AS (SELECT doc_id, least(0.4::DOUBLE, score / max(score) OVER () * 0.4::DOUBLE) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 5),
    three AS (SELECT doc_id, 0.3::DOUBLE AS score FROM c WHERE (SELECT count(*) FROM s) = 0 ORDER BY relevance DESC, doc_id LIMIT 3)
    SELECT doc_id, round(score, 6) AS score FROM five UNION ALL SELECT doc_id, round(score, 6) FROM three""".replace(" s AS (SELECT doc_id, score FROM bm", " raw_hits AS (SELECT doc_id, score FROM bm").replace("FROM s ORDER BY s.score", "FROM raw_hits ORDER BY raw_hits.score").replace("count(*) FROM s)", "count(*) FROM raw_hits)")
)
def a20_r6_j14_rescored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text scores of the documents that describe the units asked for: at least 0.5, as a share of their best, the best five; if there are none, three by relevance at 0.3."""
    candidates = section_tags(sections(spark, sf_dir)).where(F.col("tag").isin("P-101", "P-117", "P-125")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("relevance"))
    hits = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY).join(candidates, "doc_id", "left_semi").where("score >= 0.5")
    best = search.normalised(hits.orderBy(F.col("score").desc(), "doc_id").limit(5))
    none = hits.agg((F.count(F.lit(1)) == 0).alias("none"))  # one row
    three = candidates.orderBy(F.col("relevance").desc(), "doc_id").limit(3).crossJoin(F.broadcast(none)).where("none").select("doc_id", F.lit(0.3).alias("score"))
    return best.unionByName(three).withColumn("score", F.round("score", 6))


@operator(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), t AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w)
    SELECT doc_id, term, count(*) AS tf, length FROM t GROUP BY doc_id, term, length"""
)
def v9_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("length", F.col("length").cast("long"))


SHINGLE = "list_distinct(list_filter(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) ELSE [] END, lambda p: length(p) > 10))"
OVERLAP = f"""b AS (SELECT item_id, {SHINGLE} AS p FROM (SELECT item_id, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '\\S+') AS w FROM benchmark)),
d AS (SELECT doc_id, {SHINGLE} AS p FROM (SELECT doc_id, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '\\S+') AS w FROM documents)),
o AS (SELECT item_id, doc_id, len(list_intersect(b.p, d.p)) AS common, len(b.p) AS phrases FROM b JOIN d ON list_has_any(b.p, d.p)),
s AS (SELECT *, common / phrases::DOUBLE AS overlap FROM o)"""


def overlap_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fold = lambda c: F.replace(c, F.lit("ß"), F.lit("ss"))
    b = table(spark, sf_dir, "benchmark").select("item_id", fold(F.col("text")).alias("answer"))
    return b, table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("context"))


@operator(f"WITH {OVERLAP}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS k FROM s) SELECT item_id, doc_id, round(overlap, 6) AS overlap, k FROM r WHERE (overlap > 0.03 OR k <= 2) AND k <= 5")
def r23_o10_u5_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts cited by an answer: those with over 3 % of its phrases, two in any case, five at most."""
    best = attribution.top_overlaps(*overlap_texts(spark, sf_dir), "item_id", "doc_id", 5)
    return best.where((F.col("overlap") > 0.03) | (F.col("k") <= 2)).select("item_id", "doc_id", F.round("overlap", 6).alias("overlap"), "k")


@operator(
    """WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'not found|no information|cannot') THEN 'marker' WHEN length(text) < 100 AND regexp_matches(lower(text), 'no|not|unable') THEN 'short'
      ELSE 'good' END AS verdict FROM t"""
)
def r17_answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    verdict = F.when(T.any_of(low, ["not found", "no information", "cannot"]), "marker").when((F.length("text") < 100) & T.any_of(low, ["no", "not", "unable"]), "short").otherwise("good")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", verdict.alias("verdict"))


@operator(
    """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, list_sort(list(value))[(count(*) * 0.5::DOUBLE)::BIGINT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.95::DOUBLE)::BIGINT + 1] AS p95,
      list_sort(list(value))[floor(count(*) * 0.99::DOUBLE)::BIGINT + 1] AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""".replace("(count(*) * 0.5::DOUBLE)::BIGINT", "floor(count(*) * 0.5::DOUBLE)::BIGINT")
)
def a10_latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at place floor(n * p) of the sorted ones, for all groups at once by refined histograms."""
    e = table(spark, sf_dir, "events")
    places = {"m1": lambda n: F.floor((n - 1) / 2), "m2": lambda n: F.floor(n / 2), "p50": lambda n: F.floor(n * 0.5), "p95": lambda n: F.floor(n * 0.95), "p99": lambda n: F.floor(n * 0.99)}
    found = order_statistics.at_places(e, ["event_type"], "value", places)
    sums = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return sums.join(found, "event_type").select("event_type", F.round("mean", 6).alias("mean"), F.round((F.col("m1") + F.col("m2")) / 2, 6).alias("median"), "p50", "p95", "p99", "least", "most")


SETS = """x AS (SELECT user_id AS q, list(DISTINCT event_type) FILTER (event_id % 3 <> 0) AS e0, list(DISTINCT event_type) FILTER (event_id % 4 = 1) AS f0 FROM events GROUP BY user_id),
s AS (SELECT q, coalesce(e0, []) AS e, coalesce(f0, []) AS f, len(list_intersect(coalesce(e0, []), coalesce(f0, []))) AS hit FROM x)"""


def event_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("q")).agg(
        F.sort_array(F.collect_set(F.when(F.col("event_id") % 3 != 0, F.col("event_type")))).alias("e"), F.sort_array(F.collect_set(F.when(F.col("event_id") % 4 == 1, F.col("event_type")))).alias("f")
    )


@operator(
    f"""WITH {SETS}, p AS (SELECT q, CASE WHEN len(e) = 0 AND len(f) = 0 THEN 1 WHEN len(e) = 0 THEN 0 WHEN len(f) = 0 THEN 1 ELSE hit / len(f)::DOUBLE END::DOUBLE AS p, CASE WHEN len(e) = 0 THEN 1 WHEN len(f) = 0 THEN 0 ELSE hit / len(e)::DOUBLE END::DOUBLE AS r,
      len(e) = 0 AND len(f) = 0 AS none, len(e) = 0 OR len(f) = 0 AS one FROM s)
    SELECT q, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN none THEN 1 WHEN one THEN 0 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE, 6) AS f1 FROM p"""
)
def a14_u4_inclusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sets(spark, sf_dir).select("q", M.set_scores(F.col("e"), F.col("f")).alias("s"))
    return s.select("q", *(F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


@operator(
    f"""WITH {SETS}, c AS (SELECT q, e, f, hit, greatest(0, len(f) - hit - greatest(1, floor(len(e) * 0.5)::INT)) AS charged FROM s),
    p AS (SELECT q, e, f, CASE WHEN len(e) = 0 AND len(f) = 0 THEN 1 WHEN len(e) = 0 THEN 0.5 WHEN len(f) = 0 THEN 0 WHEN hit + charged > 0 THEN hit / (hit + charged)::DOUBLE ELSE 1 END::DOUBLE AS p, CASE WHEN len(e) = 0 THEN 1 WHEN len(f) = 0 THEN 0 ELSE hit / len(e)::DOUBLE END::DOUBLE AS r FROM c)
    SELECT q, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN len(e) = 0 AND len(f) = 0 THEN 1 WHEN len(e) = 0 THEN 0.67 WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END::DOUBLE, 6) AS fbeta FROM p"""
)
def a15_citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sets(spark, sf_dir).select("q", M.citation_scores(F.col("e"), F.col("f")).alias("s"))
    return s.select("q", *(F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "fbeta")))


@operator(
    """WITH e AS (SELECT DISTINCT user_id, event_type AS tool FROM events WHERE event_id % 3 <> 0), u AS (SELECT DISTINCT user_id, event_type AS tool FROM events WHERE event_id % 4 = 1), n AS (SELECT event_type AS tool, count(*) AS used_raw FROM events WHERE event_id % 4 = 1 GROUP BY ALL),
    j AS (SELECT coalesce(e.tool, u.tool) AS tool, e.user_id IS NOT NULL AS ex, u.user_id IS NOT NULL AS us FROM e FULL JOIN u ON e.user_id = u.user_id AND e.tool = u.tool),
    c AS (SELECT tool, sum(ex::INT) AS expected, sum(us::INT) AS used, sum((ex AND us)::INT) AS correct FROM j GROUP BY tool)
    SELECT c.tool, expected::BIGINT AS expected, used::BIGINT AS used, correct::BIGINT AS correct, coalesce(used_raw, 0) AS used_raw, round(correct / used::DOUBLE, 6) AS "precision", round(correct / expected::DOUBLE, 6) AS recall FROM c LEFT JOIN n ON c.tool = n.tool"""
)
def a12_u8_tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tool"), (F.col("event_id") % 3 != 0).alias("ex"), (F.col("event_id") % 4 == 1).alias("us"))
    sets = ev.groupBy("user_id", "tool").agg(F.bool_or("ex").alias("ex"), F.bool_or("us").alias("us"), F.count_if("us").alias("raw"))
    n = lambda c: F.count_if(c)
    both = F.col("ex") & F.col("us")
    found = sets.groupBy("tool").agg(n(F.col("ex")).alias("expected"), n(F.col("us")).alias("used"), n(both).alias("correct"), F.sum("raw").alias("used_raw"))
    return found.withColumns({"precision": F.round(M.ratio(F.col("correct"), F.col("used")), 6), "recall": F.round(M.ratio(F.col("correct"), F.col("expected")), 6)})


@operator(
    """SELECT event_type AS primary_type, count(*) AS questions, round(avg(value), 6) AS mean_latency, round(avg((value > 5)::INT), 6) AS answer_rate, round(avg(value) FILTER (value > 5), 6) AS answered_mean FROM events GROUP BY event_type"""
)
def a11_a13_by_question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") > 5
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("primary_type")).agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("value"), 6).alias("mean_latency"), F.round(F.avg(ok.cast("int")), 6).alias("answer_rate"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("answered_mean")
    )


@operator("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars > 1000) AS long_docs FROM documents GROUP BY source, lang")
def a17_a5_a18_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1000).alias("long_docs"))


@operator("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src1' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 0")
def o12_o13_p15_p16_page_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of what a user may see."""
    d = table(spark, sf_dir, "documents").where(filters.may_access(F.col("source"), "src1", "user") & (F.col("lang") == "en"))
    return filters.page_of(d, [F.col("n_chars").desc(), "doc_id"], 1, 10).select("doc_id", "source", "n_chars")


@operator(
    """SELECT event_id, user_id, (count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)) AS in_window FROM events"""
)
def w9_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    over = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3600 * 10**6, 0)
    return e.select("event_id", "user_id", F.count(F.lit(1)).over(over).alias("in_window"))


@operator()
def st1_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 requests in any two days for each user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    return rate_limit.replay(e, 3, 2 * 86400.0).select("event_id", "key", "allowed", "retry_after")


@operator("SELECT conv_id, count(*) FILTER (role = 'user') AS users, bool_or(length(text) > 900) AS expanded, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def r25_u7_answer_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.bool_or(F.length("text") > 900).alias("expanded"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


@operator("SELECT sha256(html) AS file_hash, count(*) AS files, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def s5_s15_storage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.sha2("html", 256).alias("file_hash")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("html")).alias("bytes"))
