"""Entity search as a composition, node assembly, and small remaining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.functions import maths as M
from doclattice.functions import text as T
from doclattice.operators import entities, graph, scroll
from doclattice.operators.small import sent
from doclattice.plans.base import BOXES, SECTIONS, operator
from doclattice.sources import files
from doclattice.sources.tables import boxes, sections, table

VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


#: Parts of a parsed query that only read, by class name; anything else is refused, commands and table functions included.
READS = frozenset(
    "Project Filter Sort GlobalLimit LocalLimit Offset Aggregate Distinct Union Except Intersect Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedHaving"
    " UnresolvedWith UnresolvedRelation OneRowRelation UnresolvedInlineTable WithWindowDefinition Window".split()
)
#: Functions that call into the host.
HOST_FUNCTIONS = frozenset(["reflect", "java_method", "try_reflect"])


def parts(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def relations(plan, known: frozenset = frozenset()) -> set[str]:
    """Names of the tables that a parsed plan reads, in sub-queries too, but for its own common table expressions; an error for whatever does more than read."""
    kind = plan.getClass().getSimpleName()
    if kind not in READS:
        raise ValueError(f"only queries are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        names = parts(plan.multipartIdentifier())
        if len(names) != 1:
            raise ValueError(f"no path, catalog or schema may be named: {names}")
        return set() if names[0].lower() in known else {names[0]}
    found: set[str] = set()
    if kind == "UnresolvedWith":
        for made in parts(plan.cteRelations()):
            found |= relations(made._2(), known)
            known = known | {made._1().lower()}
    for child in parts(plan.children()):
        found |= relations(child, known)
    for expression in parts(plan.expressions()):
        found |= expression_relations(expression, known)
    return found


def expression_relations(expression, known: frozenset) -> set[str]:
    kind = expression.getClass().getSimpleName()
    found: set[str] = set()
    if kind == "UnresolvedFunction":
        names = parts(expression.nameParts())
        if len(names) != 1 or names[0].lower() in HOST_FUNCTIONS:
            raise ValueError(f"a function that is not allowed: {names}")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery"):
        found |= relations(expression.query().plan() if kind == "InSubquery" else expression.plan(), known)
    for child in parts(expression.children()):
        found |= expression_relations(child, known)
    return found


def read_only(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    """A query text over allow-listed views only: Spark's own parser decides what it is, and its plan, walked with all sub-queries, what it reads."""
    used = relations(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
    if not used <= set(tables):
        raise ValueError(f"tables that are not allowed: {sorted(used - set(tables))}")
    for name in used:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


@operator("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def p14_s16_read_only_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_only(spark, sf_dir, "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", VIEWS)


@operator("SELECT doc_id, len(l) >= 2 AND len(string_split(l[1], ' ')) >= 2 AND len(list_filter(l, lambda c: trim(c) <> '')) > 0 AS valid FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def p18_valid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    ok = (F.size(lines) >= 2) & (F.size(F.split(lines[0], " ")) >= 2) & F.exists(lines, lambda c: F.trim(c) != "")
    return table(spark, sf_dir, "documents").select("doc_id", ok.alias("valid"))


@operator(
    """SELECT p_partkey, array_to_string(list_transform(string_split('main-' || p_name, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '-')), ' ') AS title,
       regexp_replace('```csv' || chr(10) || p_name || chr(10) || '```', '^```[a-z]*\\n|\\n```$', '', 'g') AS body FROM part"""
)
def f10_f11_title_case_and_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part of hyphenated words is capitalised; fences around a response go."""
    cap = lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 10**6)))
    title = F.array_join(F.transform(F.split(F.concat(F.lit("main-"), "p_name"), " "), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda x: cap(x)), "-")), " ")
    body = F.regexp_replace(F.concat(F.lit("```csv\n"), "p_name", F.lit("\n```")), r"^```[a-z]*\n|\n```$", "")
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), body.alias("body"))


@operator(
    """WITH q AS (SELECT unnest(range(3)) AS q, unnest(['is the fo line hot', 'where is the ring of HE', 'no match']) AS question), a AS (SELECT * FROM (VALUES ('FO', 'sys_fuel'), ('HE', 'sys_heat'), ('IS', 'sys_is')) AS a(abbr, code)),
    t AS (SELECT q, question, unnest(regexp_extract_all(upper(question), '\\b[A-Z]{2,5}\\b')) AS tok FROM q),
    k AS (SELECT * FROM (VALUES ('ring', 'sys_ring'), ('hot', 'sys_heat')) AS k(word, code))
    SELECT DISTINCT q::INT AS q, code FROM t JOIN a ON tok = abbr UNION SELECT q, code FROM q JOIN k ON contains(lower(question), word)"""
)
def e8_question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations among a question's upper-cased words, and keywords in it. Questions and dictionaries are stated lists."""
    q = spark.sql("SELECT posexplode(array('is the fo line hot', 'where is the ring of HE', 'no match')) AS (q, question)")
    a = spark.sql("SELECT * FROM VALUES ('FO', 'sys_fuel'), ('HE', 'sys_heat'), ('IS', 'sys_is') AS a(tok, code)")
    k = spark.sql("SELECT * FROM VALUES ('ring', 'sys_ring'), ('hot', 'sys_heat') AS k(keyword, code)")
    tokens = q.select("q", F.explode(F.regexp_extract_all(F.upper("question"), F.lit(r"\b[A-Z]{2,5}\b"), F.lit(0))).alias("tok"))
    return tokens.join(sent(a), "tok").select("q", "code").union(entities.dictionary_hits(q, "q", "question", k)).distinct()


@operator(
    f"""WITH {BOXES}, t AS (SELECT doc_id, page, box_id, x1 - x0 AS w FROM boxes WHERE kind = 'table')
    SELECT doc_id, page, box_id, box_id || '_chunk_' || i AS chunk_id, i::INT AS chunk_index, n::INT AS total_chunks FROM (SELECT *, greatest(1, floor(w / 100))::INT AS n, unnest(range(greatest(1, floor(w / 100))::BIGINT)) AS i FROM t)"""
)
def t31_table_nodes_and_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).where("kind = 'table'")
    n = F.greatest(F.lit(1), F.floor((F.col("box.x1") - F.col("box.x0")) / 100)).cast("int")
    spread = b.withColumn("total_chunks", n).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    return spread.select("doc_id", "page", "box_id", F.concat("box_id", F.lit("_chunk_"), "chunk_index").alias("chunk_id"), "chunk_index", "total_chunks")


@operator(
    f"""WITH {SECTIONS}, o AS (SELECT doc_id, section_no, 'v1' AS version FROM sections), g AS (SELECT doc_id, section_no, 'v2' AS version FROM sections WHERE doc_id % 10 = 4 AND section_no % 2 = 0)
    SELECT doc_id, count(*) AS n, max(version) AS version FROM (SELECT * FROM o WHERE doc_id % 10 <> 4 UNION ALL SELECT * FROM g) GROUP BY doc_id"""
)
def m4_m5_s14_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's sections are replaced as a whole: what is there for it goes, what was rebuilt comes."""
    s = sections(spark, sf_dir).select("doc_id", "section_no")
    new = s.where("doc_id % 10 = 4 AND section_no % 2 = 0").withColumn("version", F.lit("v2"))
    kept = graph.without(s.withColumn("version", F.lit("v1")), s.where("doc_id % 10 = 4"), "doc_id").select("doc_id", "section_no", "version")
    return kept.unionByName(new).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))


@operator(
    """WITH h AS (SELECT vec_id AS hit, CASE vec_id % 2 WHEN 0 THEN 'table' ELSE 'schema' END AS kind, label AS q FROM embeddings), s AS (SELECT q, kind, min(hit) AS chosen FROM h WHERE hit % 9 = 0 GROUP BY ALL), f AS (SELECT q, kind, min(hit) AS first_hit FROM h GROUP BY ALL)
    SELECT f.q, f.kind, coalesce(chosen, first_hit) AS hit FROM f LEFT JOIN s ON f.q = s.q AND f.kind = s.kind"""
)
def r24_intent_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answer chose, else the first that there is."""
    kind = F.when(F.col("vec_id") % 2 == 0, "table").otherwise("schema")
    h = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hit"), kind.alias("kind"), F.col("label").alias("q"))
    return h.groupBy("q", "kind").agg(F.coalesce(F.min(F.when(F.col("hit") % 9 == 0, F.col("hit"))), F.min("hit")).alias("hit"))


@operator("SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 10")
def s20_o16_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a scan with a filter, in the order of the key."""
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source").orderBy("doc_id").offset(10).limit(20)


@operator(
    """WITH k AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 + 1 AS page FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'))
    SELECT page, min(doc_id) AS "first", max(doc_id) AS "last", count(*) AS rows FROM k JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id) GROUP BY page"""
)
def s20_o16_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursors of all pages of a filtered table: a page is what stands between two of them."""
    whole = scroll.build(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", files.scratch(spark))
    return whole.cursors(50, F.col("lang") == "en").select(F.col("page").cast("long").alias("page"), "first", "last", "rows")


@operator(
    """WITH k AS (SELECT doc_id, source FROM documents WHERE lang = 'en' AND doc_id > (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id OFFSET 9 LIMIT 1) ORDER BY doc_id LIMIT 20) SELECT * FROM k"""
)
def s20_page_behind_a_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered table, from the last key of the first one."""
    whole = scroll.build(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", files.scratch(spark))
    ok = F.col("lang") == "en"
    cursor = whole.page(10, None, ok).agg(F.max("doc_id")).first()[0]
    return whole.page(20, cursor, ok).select("doc_id", "source")


@operator(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, len(list_filter(a.embedding, lambda x: x > 0)) AS positives FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def f21_f23_vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one: a join by key."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(M.dot(F.col("embedding"), F.col("next")), 6).alias("dot"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positives"))


@operator("SELECT url, CASE WHEN regexp_matches(url, '\\.pdf$') THEN 'application/pdf' WHEN regexp_matches(url, '\\.png$') THEN 'image/png' ELSE 'text/html' END AS mime, base64(left(url, 10)::BLOB) AS b64, strftime(DATE '2024-01-01' + (page_id % 28)::INT, '%Y-%m-%d') AS day FROM pages")
def f27_f30_types_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    mime = F.when(F.rlike(u, F.lit(r"\.pdf$")), "application/pdf").when(F.rlike(u, F.lit(r"\.png$")), "image/png").otherwise("text/html")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "pages").select("url", mime.alias("mime"), F.base64(F.encode(F.left(u, F.lit(10)), "utf-8")).alias("b64"), day.alias("day"))
