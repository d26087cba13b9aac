"""Queries that follow a question: routing, entities, hits, context, fallbacks and what an answer shows.

The questions of a search are the vectors whose id is divisible by 100; those of routing and of entity search are all turns of users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.functions import answers as A
from doclattice.functions import maths as M
from doclattice.functions import text as T
from doclattice.operators import entities, search
from doclattice.operators.small import sent
from doclattice.plans.base import operator
from doclattice.plans.search_queries import BM25, COS, QUERY, SHINGLE, points
from doclattice.sources.tables import table


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# ---------------------------------------------------------------- questions in words

ASKED = """asked AS (SELECT conv_id, turn, CASE conv_id % 4
    WHEN 0 THEN text || ' at unit P-' || (100 + conv_id % 47)
    WHEN 1 THEN 'Where is the small ring of unit p-' || (100 + turn % 40) || '? ' || text
    WHEN 2 THEN text || ' Show the diagram and the rated capacity of the hot bolt'
    ELSE 'What is the cause of it? ' || text END AS question FROM conversations WHERE role = 'user'),
units AS (SELECT coalesce(f.tag, t.tag) AS tag, coalesce(n_figures, 0) AS n_figures, coalesce(n_tables, 0) AS n_tables
    FROM (SELECT 'P-' || (100 + doc_id % 37) AS tag, count(*) AS n_figures FROM documents GROUP BY 1) f FULL JOIN (SELECT 'P-' || (100 + p_partkey % 41) AS tag, count(*) AS n_tables FROM part GROUP BY 1) t ON f.tag = t.tag),
coded AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(upper(question), '\\b([A-Z]{1,4})[-–]([0-9]{2,4}[A-Z]?)\\b')) AS tag FROM asked)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question: the turns of users; most name a unit or a component."""
    k, unit = F.col("conv_id") % 4, lambda n: (100 + n).cast("string")
    question = (
        F.when(k == 0, F.concat("text", F.lit(" at unit P-"), unit(F.col("conv_id") % 47)))
        .when(k == 1, F.concat(F.lit("Where is the small ring of unit p-"), unit(F.col("turn") % 40), F.lit("? "), "text"))
        .when(k == 2, F.concat("text", F.lit(" Show the diagram and the rated capacity of the hot bolt")))
        .otherwise(F.concat(F.lit("What is the cause of it? "), "text"))
    )
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", question.alias("question"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag, n_figures, n_tables: what is known of each unit."""
    tag = lambda key, n: F.concat(F.lit("P-"), (100 + F.pmod(key, F.lit(n))).cast("string")).alias("tag")
    f = table(spark, sf_dir, "documents").groupBy(tag("doc_id", 37)).agg(F.count(F.lit(1)).alias("n_figures"))
    t = table(spark, sf_dir, "part").groupBy(tag("p_partkey", 41)).agg(F.count(F.lit(1)).alias("n_tables"))
    return f.join(t, "tag", "full_outer").select("tag", F.coalesce("n_figures", F.lit(0)).alias("n_figures"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"))


def coded(questions: DataFrame) -> DataFrame:
    tags = F.array_distinct(F.regexp_extract_all(F.upper("question"), F.lit(entities.TAG), F.lit(0)))
    return questions.select("conv_id", "turn", F.explode(tags).alias("tag"))


@operator(
    f"""WITH {ASKED}, known AS (SELECT conv_id, turn, sum(n_figures) AS n_figures, sum(n_tables) AS n_tables FROM coded JOIN units USING (tag) GROUP BY ALL),
    r AS (SELECT a.conv_id, a.turn, lower(question) AS low, k.conv_id IS NOT NULL AS has, coalesce(n_figures, 0) AS n_figures, coalesce(n_tables, 0) AS n_tables,
      CASE a.conv_id % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'schema' WHEN 3 THEN 'mixed' END AS named,
      CASE a.conv_id % 5 WHEN 0 THEN ['tables', 'other'] WHEN 1 THEN ['text', 'entities'] WHEN 4 THEN ['tables', 'figures'] ELSE [] END AS listed
      FROM asked a LEFT JOIN known k ON a.conv_id = k.conv_id AND a.turn = k.turn),
    i AS (SELECT *, CASE WHEN named IS NOT NULL AND len(listed) > 0 THEN named WHEN list_contains(listed, 'tables') AND list_contains(listed, 'figures') THEN 'mixed'
      WHEN list_contains(listed, 'figures') THEN 'schema' WHEN list_contains(listed, 'tables') THEN 'table' ELSE 'text' END AS intent FROM r)
    SELECT conv_id, turn, intent, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_filter(listed, lambda t: t <> 'other' AND (t <> 'entities' OR has)),
        [CASE WHEN intent IN ('table', 'mixed') OR {any_sql('low', A.SPEC_WORDS)} THEN 'tables' END, CASE WHEN intent IN ('schema', 'mixed') OR {any_sql('low', A.VISUAL_WORDS)} THEN 'figures' END, CASE WHEN has THEN 'entities' END]),
        lambda t: t IS NOT NULL))), ',') AS tools,
      CASE WHEN (n_tables > 0 AND intent = 'text') OR (n_figures > 0 AND intent IN ('text', 'table')) THEN 'mixed' ELSE intent END AS corrected FROM i"""
)
def r1_r2_r8_intent_and_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent and tools of each question: read from the model's answer, completed by what the question calls for, the intent corrected by what its units are found in."""
    q = asked(spark, sf_dir)
    known = coded(q).join(sent(units(spark, sf_dir)), "tag").groupBy("conv_id", "turn").agg(F.sum("n_figures").alias("n_figures"), F.sum("n_tables").alias("n_tables"))
    k = F.col("conv_id") % 5
    response = (
        F.when(k == 0, '  Table\n["tables", "other"]').when(k == 1, '\nschema\n\n["text", "entities"]').when(k == 2, "I think that text will do").when(k == 3, "mixed\nno list").otherwise('none\n["tables", "figures"]')
    )
    both = q.join(known, ["conv_id", "turn"], "left").withColumn("r", A.routed(response, F.col("question"), F.col("n_figures").isNotNull()))
    corrected = A.corrected_intent(F.col("r.intent"), F.coalesce("n_tables", F.lit(0)), F.coalesce("n_figures", F.lit(0)))
    return both.select("conv_id", "turn", "r.intent", F.array_join("r.tools", ",").alias("tools"), corrected.alias("corrected"))


NAMES = "names AS (SELECT DISTINCT lower(p_name) AS name FROM part)"


@operator(
    f"""WITH {ASKED}, {NAMES}, w AS (SELECT conv_id, turn, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM asked), p AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    ph AS (SELECT conv_id, turn, w[i:i+1] AS ws, 6 AS least FROM p WHERE i < len(w) UNION ALL SELECT conv_id, turn, w[i:i+2], 8 FROM p WHERE i + 1 < len(w)),
    phrases AS (SELECT DISTINCT conv_id, turn, array_to_string(ws, ' ') AS name FROM ph WHERE length(array_to_string(ws, ' ')) >= least AND NOT list_has_any(ws, {quoted(A.QUERY_STOP_WORDS)})),
    one AS (SELECT conv_id, turn, tag AS found, 'code' AS branch, n_tables, n_figures FROM coded JOIN units USING (tag)),
    two AS (SELECT conv_id, turn, name AS found, 'name' AS branch, 0 AS n_tables, 0 AS n_figures FROM phrases JOIN names USING (name)),
    rest AS (SELECT DISTINCT a.conv_id, a.turn, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS word FROM asked a
      WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.conv_id = a.conv_id AND o.turn = a.turn) AND NOT EXISTS (SELECT 1 FROM two t WHERE t.conv_id = a.conv_id AND t.turn = a.turn)),
    three AS (SELECT conv_id, turn, name AS found, 'prefix' AS branch, 0 AS n_tables, 0 AS n_figures FROM (SELECT DISTINCT conv_id, turn, name FROM rest JOIN names ON starts_with(name, word) WHERE length(word) >= 4 AND NOT list_contains({quoted(A.QUERY_STOP_WORDS)}, word))
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name), name) <= 8)
    SELECT conv_id, turn, found, branch, CASE WHEN n_tables > 0 THEN 0.6::DOUBLE END AS table_score, CASE WHEN n_figures > 0 THEN 0.7::DOUBLE END AS figure_score, 0.5::DOUBLE AS record_score
    FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)"""
)
def r4_r5_r7_entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each question: units by their codes and components by phrases of two and three words; where there are neither, components that begin with a word of it, eight at most.

    Scores are fixed by where an entity is found: 0.6 in tables, 0.7 in figures, 0.5 as a record.
    """
    q, key = asked(spark, sf_dir), ["conv_id", "turn"]
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    words = F.regexp_extract_all(T.lower(F.col("question")), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, A.QUERY_STOP_WORDS))

    def phrases(w, n, least):
        runs = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))
        return F.filter(F.transform(F.filter(runs, lambda r: ~F.arrays_overlap(r, stop)), lambda r: F.array_join(r, " ")), lambda p: F.length(p) >= least)

    worded = q.select(*key, words.alias("w"))
    spoken = worded.select(*key, F.explode(F.array_distinct(F.concat(phrases(F.col("w"), 2, 6), phrases(F.col("w"), 3, 8)))).alias("name"))
    none = F.lit(0).cast("long")
    one = coded(q).join(sent(units(spark, sf_dir)), "tag").select(*key, F.col("tag").alias("found"), F.lit("code").alias("branch"), "n_tables", "n_figures")
    two = spoken.join(sent(names), "name").select(*key, F.col("name").alias("found"), F.lit("name").alias("branch"), none.alias("n_tables"), none.alias("n_figures"))
    found = one.unionByName(two)
    rest = worded.join(found.select(*key).distinct(), key, "left_anti").select(*key, F.explode(F.array_distinct("w")).alias("word")).where((F.length("word") >= 4) & ~F.col("word").isin(A.QUERY_STOP_WORDS))
    begun = rest.withColumn("p", F.left("word", F.lit(4))).join(sent(names.withColumn("p", F.left("name", F.lit(4)))), "p").where(F.startswith("name", F.col("word"))).select(*key, "name").distinct()
    best = begun.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.length("name"), "name"))).where("k <= 8")
    three = best.select(*key, F.col("name").alias("found"), F.lit("prefix").alias("branch"), none.alias("n_tables"), none.alias("n_figures"))
    score = lambda n, v: F.when(F.col(n) > 0, F.lit(v))
    return found.unionByName(three).select(*key, "found", "branch", score("n_tables", 0.6).alias("table_score"), score("n_figures", 0.7).alias("figure_score"), F.lit(0.5).alias("record_score"))


EXPANDED = "CASE " + " ".join(f"WHEN contains(low, '{a}') THEN regexp_replace(low, '\\b{a}\\b', '{b}', 'g')" for a, b in A.SYNONYMS.items()) + " END"


@operator(
    rf"""WITH {ASKED}, q AS (SELECT conv_id, turn, question, lower(question) AS low FROM asked) SELECT conv_id, turn, {EXPANDED} AS expanded,
      array_to_string(list_concat(list_filter(regexp_extract_all(low, '\S+'), lambda w: length(w) > 2 AND NOT list_contains({quoted(A.QUESTION_WORDS)}, w)),
        list_transform(regexp_extract_all(question, '\b[A-Z]{{2,}}[-]?[0-9]*\b|\b[0-9]+[A-Z]+\b'), lambda c: lower(c)))[1:10], ' ') AS rephrased,
      array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]{{3,}}') AND NOT list_contains({quoted(A.QUERY_STOP_WORDS)}, w)))), ',') AS words FROM q"""
)
def r19_u6_query_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with a synonym, in the words that matter, and as a set of words."""
    q = F.col("question")
    return asked(spark, sf_dir).select("conv_id", "turn", A.expanded(q).alias("expanded"), A.rephrased(q).alias("rephrased"), F.array_join(A.query_words(q), ",").alias("words"))


# ---------------------------------------------------------------- hits of vectors

HITS = f"""hits AS (SELECT a.vec_id AS q, b.vec_id AS hit_id, b.label AS doc, b.vec_id // 5 AS section, CASE b.vec_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'schema' END AS kind, {COS} AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND {COS} >= 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id, kind ORDER BY score DESC, b.vec_id) <= 10)"""
IMPORTANCE = "coalesce(nullif(CASE WHEN section % 4 = 0 THEN NULL ELSE (section % 10) / 10.0::DOUBLE END, 0), 0.5)::DOUBLE"
ANCHORS = f"""{HITS}, per_section AS (SELECT q, doc, section, max(score) AS top, arg_min(kind, hit_id) AS source FROM hits GROUP BY ALL),
anchors AS (SELECT q, doc, section, source, CASE WHEN source = 'schema' THEN 0.5::DOUBLE + 0.3::DOUBLE * {IMPORTANCE} ELSE 0.7::DOUBLE * top + 0.2::DOUBLE * {IMPORTANCE} END AS final FROM per_section
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(CASE WHEN source = 'schema' THEN 0.5::DOUBLE + 0.3::DOUBLE * {IMPORTANCE} ELSE 0.7::DOUBLE * top + 0.2::DOUBLE * {IMPORTANCE} END, 9) DESC, doc, section) <= 5),
votes AS (SELECT q, doc, sum(score) AS vote, count(*) AS n FROM (SELECT * FROM hits WHERE kind <> 'text' QUALIFY row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, hit_id) <= 5) GROUP BY ALL),
primary_doc AS (SELECT q, doc, vote, n FROM votes QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(vote, 9) DESC, doc) = 1)"""


def ranked(rows: DataFrame, by: list[str], *order, name: str = "k") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def best_first(rows: DataFrame, *by: str, name: str = "k") -> DataFrame:
    return ranked(rows, list(by), F.col("score").desc(), "hit_id", name=name)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, hit_id, doc, section, kind, score: of each question the ten nearest rows of each kind."""
    e, k = points(spark, sf_dir), F.col("vec_id") % 3
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    p = e.select(
        F.col("vec_id").alias("hit_id"), F.col("label").alias("doc"), F.floor(F.col("vec_id") / 5).alias("section"), F.when(k == 0, "text").when(k == 1, "table").otherwise("schema").alias("kind"), F.col("embedding").alias("p")
    )
    return search.top_k(q, p, 10, 0.0, "q_id", "hit_id", each=["kind"], others=True).select(F.col("q_id").alias("q"), "hit_id", "doc", "section", "kind", "score")


def importance() -> F.Column:
    """A section's stored importance; a missing or zero one counts as 0.5."""
    stored = F.when(F.col("section") % 4 != 0, (F.col("section") % 10) / 10.0)
    return F.coalesce(F.nullif(stored, F.lit(0.0)), F.lit(0.5))


def anchors(found: DataFrame) -> DataFrame:
    """q, doc, section, source, final: the five best sections of a question by best hit and importance."""
    g = found.groupBy("q", "doc", "section").agg(F.max("score").alias("top"), F.min_by("kind", "hit_id").alias("source"))
    final = F.when(F.col("source") == "schema", 0.5 + 0.3 * importance()).otherwise(0.7 * F.col("top") + 0.2 * importance())
    scored = g.select("q", "doc", "section", "source", final.alias("final"))
    return ranked(scored, ["q"], F.round("final", 9).desc(), "doc", "section").where("k <= 5").drop("k")


def primary_documents(found: DataFrame) -> DataFrame:
    """q, doc, vote, n: the document for which the five best tables and the five best figures of a question vote by their scores."""
    voting = best_first(found.where("kind <> 'text'"), "q", "kind").where("k <= 5")
    votes = voting.groupBy("q", "doc").agg(F.sum("score").alias("vote"), F.count(F.lit(1)).alias("n"))
    return ranked(votes, ["q"], F.round("vote", 9).desc(), "doc").where("k = 1").drop("k")


@operator(f"WITH {ANCHORS} SELECT q, doc, section, source, round(final, 6) AS final FROM anchors")
def r9_a7_o7_j22_anchor_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(hits(spark, sf_dir)).withColumn("final", F.round("final", 6))


@operator(f"WITH {ANCHORS} SELECT q, doc, round(vote, 6) AS vote, n FROM primary_doc")
def a8_r10_r11_primary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primary_documents(hits(spark, sf_dir)).withColumn("vote", F.round("vote", 6))


@operator(
    f"""WITH {ANCHORS}, t AS (SELECT h.*, a.section IS NOT NULL AS anchor, p.doc IS NOT NULL AS main FROM hits h LEFT JOIN anchors a ON h.q = a.q AND h.doc = a.doc AND h.section = a.section LEFT JOIN primary_doc p ON h.q = p.q AND h.doc = p.doc),
    r AS (SELECT *, row_number() OVER (PARTITION BY q, anchor, main, kind = 'text' ORDER BY score DESC, hit_id) AS k FROM t)
    SELECT q, hit_id, kind, CASE WHEN kind <> 'text' THEN 'main' WHEN anchor THEN 'anchor' ELSE 'added' END AS reason FROM r WHERE (kind = 'text' AND (anchor OR (main AND k <= 3))) OR (kind <> 'text' AND main)"""
)
def r12_r13_context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of anchor sections always, of the primary document three more; tables and figures of the primary document."""
    h = hits(spark, sf_dir)
    a = anchors(h).select("q", "doc", "section", F.lit(True).alias("anchor"))
    main = primary_documents(h).select("q", "doc", F.lit(True).alias("main"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    marked = h.join(a, ["q", "doc", "section"], "left").join(main, ["q", "doc"], "left").withColumns({"anchor": yes("anchor"), "main": yes("main"), "is_text": F.col("kind") == "text"})
    kept = best_first(marked, "q", "anchor", "main", "is_text").where("is_text AND (anchor OR (main AND k <= 3)) OR (NOT is_text AND main)")
    return kept.select("q", "hit_id", "kind", F.when(~F.col("is_text"), "main").when(F.col("anchor"), "anchor").otherwise("added").alias("reason"))


@operator(
    f"""WITH {HITS}, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS w FROM documents),
    d AS (SELECT q, doc, count(*) AS n, avg(score) AS mean, list_distinct(flatten(list(coalesce(w, [])))) AS words FROM hits LEFT JOIN w ON hit_id = doc_id GROUP BY ALL),
    s AS (SELECT doc_id AS q, list_filter(w, lambda x: NOT list_contains({quoted(A.RELEVANCE_STOP_WORDS)}, x)) AS asked FROM w),
    m AS (SELECT d.q, doc, 0.8::DOUBLE + 0.4::DOUBLE * (0.3::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE) + 0.4::DOUBLE * mean
      + 0.3::DOUBLE * CASE WHEN coalesce(len(asked), 0) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(asked, words)) / len(asked)::DOUBLE END) AS mult FROM d LEFT JOIN s ON d.q = s.q)
    SELECT h.q, hit_id, h.doc, kind, round(least(1.0::DOUBLE, score * mult), 6) AS boosted FROM hits h JOIN m ON h.q = m.q AND h.doc = m.doc"""
)
def r15_a9_document_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits lifted by how relevant their document is to the question: by its number of hits, their mean score, and the share of the question's words that its hits hold.

    The text of a vector is the document of its id, if there is one; the hits of a question are thirty at most.
    """
    h = hits(spark, sf_dir)
    w = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.words(F.lower("text"))).alias("w"))
    held = h.join(w.select(F.col("doc_id").alias("hit_id"), "w"), "hit_id", "left")
    d = held.groupBy("q", "doc").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("w", F.array().cast("array<string>"))))).alias("words"))
    asked_words = F.array_except("w", F.array(*map(F.lit, A.RELEVANCE_STOP_WORDS)))
    s = w.join(h.select(F.col("q").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("q"), asked_words.alias("asked"))
    none = F.coalesce(F.size("asked") <= 0, F.lit(True))
    overlap = F.when(none, F.lit(0.5)).otherwise(M.ratio(F.size(F.array_intersect("asked", "words")), F.size("asked")))
    m = d.join(s, "q", "left").select("q", "doc", (0.8 + 0.4 * (0.3 * F.least(F.lit(1.0), F.col("n") / 5.0) + 0.4 * F.col("mean") + 0.3 * overlap)).alias("mult"))
    return h.join(m, ["q", "doc"]).select("q", "hit_id", "doc", "kind", F.round(F.least(F.lit(1.0), F.col("score") * F.col("mult")), 6).alias("boosted"))


@operator(
    f"""WITH {HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY q, kind, section ORDER BY score DESC, hit_id) AS d FROM hits QUALIFY d = 1), k AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, hit_id) AS k FROM f)
    SELECT q, hit_id, doc, kind, k FROM k WHERE k <= CASE kind WHEN 'text' THEN 4 WHEN 'table' THEN 3 ELSE 2 END"""
)
def o9_r14_w7_context_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit for each section and kind, then the budgets of a mixed question: 4 texts, 3 tables, 2 figures."""
    first = best_first(hits(spark, sf_dir), "q", "kind", "section", name="d").where("d = 1")
    budget = F.when(F.col("kind") == "text", 4).when(F.col("kind") == "table", 3).otherwise(2)
    return best_first(first, "q", "kind").where(F.col("k") <= budget).select("q", "hit_id", "doc", "kind", "k")


@operator(
    f"""WITH {HITS}, e AS (SELECT DISTINCT q, section, true AS found FROM hits WHERE kind = 'schema')
    SELECT h.q, hit_id, kind, round(CASE WHEN found THEN least(1.0::DOUBLE, score * 1.5::DOUBLE) ELSE score END, 6) AS score FROM hits h LEFT JOIN e ON h.q = e.q AND h.section = e.section WHERE kind <> 'schema'"""
)
def j23_p11_boost_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tables count half as much again where a figure of their section is found too."""
    h = hits(spark, sf_dir)
    e = h.where("kind = 'schema'").select("q", "section", F.lit(True).alias("found")).distinct()
    boosted = F.when(F.col("found"), F.least(F.lit(1.0), F.col("score") * 1.5)).otherwise(F.col("score"))
    return h.where("kind <> 'schema'").join(e, ["q", "section"], "left").select("q", "hit_id", "kind", F.round(boosted, 6).alias("score"))


@operator(
    f"""WITH {HITS}, c AS (SELECT q, hit_id, kind, row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, hit_id) AS i FROM hits)
    SELECT q, string_agg('[' || CASE kind WHEN 'text' THEN 'T' WHEN 'table' THEN 'TABLE' ELSE 'DIAGRAM' END || i || '] ' || hit_id, chr(10) ORDER BY kind, i) AS context FROM c GROUP BY q"""
)
def r20_a16_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each question: a bounded list of labelled parts, in order."""
    c = best_first(hits(spark, sf_dir), "q", "kind", name="i")
    label = F.when(F.col("kind") == "text", "T").when(F.col("kind") == "table", "TABLE").otherwise("DIAGRAM")
    part = F.struct("kind", "i", F.concat(F.lit("["), label, F.col("i"), F.lit("] "), F.col("hit_id")).alias("t"))
    return c.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n").alias("context"))


@operator(
    f"""WITH {HITS} SELECT q, kind, hit_id FROM hits WHERE score > 0.3 UNION ALL SELECT q, 'more' AS kind, hit_id FROM hits h WHERE score > 0.2 AND NOT EXISTS (SELECT 1 FROM hits s WHERE s.q = h.q AND s.hit_id = h.hit_id AND s.score > 0.3)"""
)
def u2_u3_u9_append_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    first = h.where("score > 0.3").select("q", "kind", "hit_id")
    more = h.where("score > 0.2").join(first, ["q", "hit_id"], "left_anti").select("q", F.lit("more").alias("kind"), "hit_id")
    return first.unionByName(more)


@operator(f"WITH {HITS} SELECT q, kind, hit_id, round(score, 6) AS score, score >= 0.5 AS combined FROM hits QUALIFY row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, hit_id) <= 5")
def v5_v6_combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each kind without a floor; those of 0.5 or more make up the combined search."""
    return best_first(hits(spark, sf_dir), "q", "kind").where("k <= 5").select("q", "kind", "hit_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("combined"))


FULL_TEXT = f"{BM25}, full_text AS (SELECT doc_id, score FROM bm WHERE score > 0.5 ORDER BY round(score, 9) DESC, doc_id LIMIT 3)"


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score: the three best documents above 0.5 for the stated words."""
    found = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY).where("score > 0.5")
    return found.orderBy(F.round("score", 9).desc(), "doc_id").limit(3)


@operator(
    f"""WITH {HITS}, {FULL_TEXT}, n AS (SELECT q, count(*) FILTER (kind = 'text' AND score > 0.3) AS good FROM hits GROUP BY q)
    SELECT q, hit_id AS id, round(score, 6) AS score, 'vector' AS source FROM hits WHERE kind = 'text' AND score > 0.3
    UNION ALL SELECT q, doc_id, round(score, 6), 'full text' FROM n, full_text WHERE good < 2"""
)
def v11_fallback_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts above 0.3; a question with fewer than two of them gets full-text hits besides, with the scores of that search."""
    h = hits(spark, sf_dir)
    good = (F.col("kind") == "text") & (F.col("score") > 0.3)
    poor = h.groupBy("q").agg(F.count_if(good).alias("good")).where("good < 2").select("q")
    more = poor.crossJoin(F.broadcast(full_text(spark, sf_dir)))  # three rows
    return h.where(good).select("q", F.col("hit_id").alias("id"), F.round("score", 6).alias("score"), F.lit("vector").alias("source")).unionByName(
        more.select("q", F.col("doc_id").alias("id"), F.round("score", 6).alias("score"), F.lit("full text").alias("source"))
    )


@operator(
    f"""WITH {HITS}, {FULL_TEXT}, r AS (SELECT DISTINCT q, q // 100 % 3 AS reason FROM hits), t AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, hit_id) AS k FROM hits),
    existing AS (SELECT DISTINCT q, doc, section FROM t WHERE kind = 'text' AND k <= 3), all_sections AS (SELECT DISTINCT label AS doc, vec_id // 5 AS section FROM embeddings),
    near AS (SELECT DISTINCT e.q, s.section AS id FROM existing e JOIN all_sections s ON e.doc = s.doc AND abs(e.section - s.section) <= 1 AND e.section <> s.section
      WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.q = e.q AND x.section = s.section)),
    unseen AS (SELECT t.q, hit_id AS id, score FROM t WHERE kind = 'text' AND score >= 0.25 AND NOT EXISTS (SELECT 1 FROM existing x WHERE x.q = t.q AND x.section = t.section) QUALIFY row_number() OVER (PARTITION BY t.q ORDER BY score DESC, hit_id) <= 5)
    SELECT r.q, doc_id AS id, round(score, 6) AS score, 'full text' AS source FROM r, full_text WHERE reason = 0 AND score > 0.4
    UNION ALL SELECT t.q, hit_id, round(score, 6), 'tables' FROM t JOIN r USING (q) WHERE reason = 0 AND kind = 'table' AND score >= 0.25 AND k <= 3
    UNION ALL SELECT q, id, 0.5::DOUBLE, 'neighbours' FROM (SELECT n.q, id, row_number() OVER (PARTITION BY n.q ORDER BY id) AS k FROM near n) JOIN r USING (q) WHERE reason = 1 AND k <= 3
    UNION ALL SELECT q, id, round(score, 6), 'rephrased' FROM unseen JOIN r USING (q) WHERE reason = 2"""
)
def r18_fallback_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More context by why an answer failed: not found, full text and tables at 0.25; too short, the sections beside those that are there; context not used, other texts at 0.25."""
    h = best_first(hits(spark, sf_dir), "q", "kind").withColumn("reason", F.floor(F.col("q") / 100) % 3)
    reasons = h.select("q", "reason").distinct()
    existing = h.where("kind = 'text' AND k <= 3").select("q", "doc", "section").distinct()
    texts = full_text(spark, sf_dir).where("score > 0.4")
    out = lambda rows, i, score, source: rows.select("q", F.col(i).alias("id"), score.alias("score"), F.lit(source).alias("source"))
    score = F.round("score", 6)
    found = out(reasons.where("reason = 0").crossJoin(F.broadcast(texts)), "doc_id", score, "full text")  # three rows
    tables = out(h.where("reason = 0 AND kind = 'table' AND score >= 0.25 AND k <= 3"), "hit_id", score, "tables")
    known = points(spark, sf_dir).select(F.col("label").alias("doc"), F.floor(F.col("vec_id") / 5).alias("section")).distinct()
    beside = existing.select("q", "doc", F.explode(F.array(F.col("section") - 1, F.col("section") + 1)).alias("section")).join(known, ["doc", "section"], "left_semi")
    beside = beside.join(existing.select("q", "section"), ["q", "section"], "left_anti").select("q", "section").distinct().join(reasons.where("reason = 1"), "q", "left_semi")
    near = out(ranked(beside, ["q"], "section").where("k <= 3"), "section", F.lit(0.5), "neighbours")
    unseen = h.where("reason = 2 AND kind = 'text' AND score >= 0.25").join(existing.select("q", "section"), ["q", "section"], "left_anti")
    other = out(best_first(unseen, "q").where("k <= 5"), "hit_id", score, "rephrased")
    return found.unionByName(tables).unionByName(near).unionByName(other)


# ---------------------------------------------------------------- answers

ANSWERS = f"""answers AS (SELECT item_id, replace(text, 'ß', 'ss') || CASE item_id % 3 WHEN 0 THEN ' as seen in [DIAGRAM2] there' WHEN 1 THEN chr(10) || '1) open the valve' || chr(10) || '2) shut it again' ELSE '' END AS answer FROM benchmark),
b AS (SELECT item_id, answer, {SHINGLE} AS p FROM (SELECT item_id, answer, regexp_extract_all(lower(answer), '\\S+') AS w FROM answers)),
d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, {SHINGLE} AS p FROM (SELECT doc_id, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '\\S+') AS w FROM documents)),
o AS (SELECT item_id, doc_id, kind, answer, len(list_intersect(b.p, d.p)) / len(b.p)::DOUBLE AS overlap FROM b JOIN d ON list_has_any(b.p, d.p)),
parts AS (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY overlap DESC, doc_id) AS i FROM o QUALIFY i <= 10)"""


@operator(
    rf"""WITH {ANSWERS}, m AS (SELECT *, contains(answer, '[' || CASE kind WHEN 'figure' THEN 'DIAGRAM' ELSE 'TABLE' END || i || ']') AS named,
      regexp_matches(answer, '\n\s*[0-9]+[).]\s+') OR (regexp_matches(answer, '\n\s*[-•]\s+') AND length(answer) - length(replace(answer, ':', '')) >= 3) OR length(answer) - length(replace(answer, chr(10), '')) >= 5 AS tabular FROM parts),
    r AS (SELECT *, named OR (kind = 'table' AND tabular AND i = 1 AND overlap > 0.05 AND NOT bool_or(named AND kind = 'table') OVER (PARTITION BY item_id)) AS referenced FROM m),
    l AS (SELECT *, CASE WHEN referenced THEN greatest(overlap, 0.1::DOUBLE) ELSE overlap END AS lifted FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY lifted DESC, doc_id) AS k FROM l WHERE referenced OR lifted >= CASE kind WHEN 'figure' THEN 0.02::DOUBLE ELSE 0.03::DOUBLE END)
    SELECT item_id, kind, doc_id, round(lifted, 6) AS overlap, referenced FROM k WHERE k <= 3"""
)
def o11_r21_r22_figures_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and tables that an answer shows: those that it names by their label, those it shares phrases with (2 % for figures, 3 % for tables), and for an answer in rows that names no table the best one above 5 %; three of each kind.

    Of each kind the ten contexts of highest overlap are the answer's labelled parts.
    """
    k = F.col("item_id") % 3
    fold = lambda c: F.replace(F.col(c), F.lit("ß"), F.lit("ss"))
    added = F.when(k == 0, " as seen in [DIAGRAM2] there").when(k == 1, "\n1) open the valve\n2) shut it again").otherwise("")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(fold("text"), added).alias("answer"))
    d = table(spark, sf_dir, "documents").select("doc_id", fold("text").alias("context"))
    kind = F.when(F.col("doc_id") % 2 == 0, "figure").otherwise("table")
    parts = ranked(search.overlap_scores(b, d, "item_id", "doc_id").withColumn("kind", kind), ["item_id", "kind"], F.col("overlap").desc(), "doc_id", name="i").where("i <= 10")
    label = F.concat(F.lit("["), F.when(F.col("kind") == "figure", "DIAGRAM").otherwise("TABLE"), F.col("i"), F.lit("]"))
    marked = parts.join(sent(b), "item_id").withColumns({"named": F.contains("answer", label), "tabular": A.is_tabular(F.col("answer"))})
    names_table = F.max(F.col("named") & (F.col("kind") == "table")).over(Window.partitionBy("item_id"))
    best_table = (F.col("kind") == "table") & F.col("tabular") & (F.col("i") == 1) & (F.col("overlap") > 0.05)
    referenced = marked.withColumn("referenced", F.col("named") | (best_table & ~names_table))
    lifted = referenced.withColumn("lifted", F.when(F.col("referenced"), F.greatest("overlap", F.lit(0.1))).otherwise(F.col("overlap")))
    shown = lifted.where(F.col("referenced") | (F.col("lifted") >= F.when(F.col("kind") == "figure", 0.02).otherwise(0.03)))
    return ranked(shown, ["item_id", "kind"], F.col("lifted").desc(), "doc_id").where("k <= 3").select("item_id", "kind", "doc_id", F.round("lifted", 6).alias("overlap"), "referenced")
