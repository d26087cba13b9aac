"""Queries over lines, sections, titles, pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.functions import ids
from doclattice.functions import text as T
from doclattice.operators import chunking, scan, structure, text_tables
from doclattice.plans.base import LINES, NUMBERED, SECTIONS, operator
from doclattice.sources.tables import lines, numbered_sections, sections, table


@operator(f"WITH {NUMBERED} SELECT doc_id, line_no, page, header, section_no FROM numbered")
def w11_section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_sections(lines(spark, sf_dir)).select("doc_id", "line_no", "page", "header", "section_no")


@operator(f"WITH {SECTIONS} SELECT doc_id, section_no, number, title, page_start, page_end, length(content) AS chars, md5(content) AS digest FROM sections")
def t15_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    return s.select("doc_id", "section_no", "number", "title", "page_start", "page_end", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@operator(f"WITH {LINES} SELECT doc_id, line_no, (length(trim(line)) BETWEEN 3 AND 150) AS fits, regexp_extract(trim(line), '^([0-9]+(?:\\.[0-9]+)*)', 1) AS number FROM lines WHERE regexp_matches(trim(line), '^[0-9]+(?:\\.[0-9]+)*\\s+\\S')")
def t11_numbered_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where(F.rlike(F.trim("line"), F.lit(r"^[0-9]+(?:\.[0-9]+)*\s+\S")))
    return rows.select("doc_id", "line_no", F.length(F.trim("line")).between(3, 150).alias("fits"), T.header_number(F.col("line")).alias("number"))


@operator(
    f"""WITH {SECTIONS} SELECT doc_id, section_no,
    CASE WHEN regexp_matches(lower(content), 'warning|danger|caution') THEN 'warning' WHEN regexp_matches(lower(content), 'note:|notice:') THEN 'note'
      WHEN regexp_matches(content, '\\|.*\\|.*\\|') THEN 'table' WHEN regexp_matches(content, '(?m)^\\s*[0-9•·]\\s+') THEN 'list' ELSE 'text' END AS section_type,
    round(least(1.0, 0.5 + 0.1 * len(list_filter(['must','shall','critical','essential','mandatory','required','safety','warning','danger','emergency','caution'], lambda k: contains(lower(content), k))))::DOUBLE, 6) AS importance
    FROM sections"""
)
def t18_a19_section_type_and_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", "section_no", T.section_type(F.col("content")).alias("section_type"), F.round(T.importance(F.col("content")), 6).alias("importance"))


@operator(
    r"""
    WITH raw AS (SELECT doc_id, text, unnest(range(len(l)))::INT AS seq, unnest(l) AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
    s AS (SELECT doc_id, seq, regexp_replace(line, '^\s+|\s+$', '', 'g') AS content FROM raw),
    k AS (SELECT * FROM s WHERE content <> ''),
    i AS (SELECT *, coalesce(sum((length(content) >= 200)::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS island FROM k)
    SELECT doc_id, island, arg_max('line ' || seq, seq) AS title, min(seq) // 10 + 1 AS page_start, count(*) AS original_count,
      md5(string_agg(content, chr(10) || chr(10) ORDER BY seq)) AS digest FROM i GROUP BY doc_id, island
    """
)
def t12_w3_merge_small_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "content"))
    named = raw.withColumns({"title": F.concat(F.lit("line "), F.col("seq")), "number": F.lit(""), "page_start": (F.floor(F.col("seq") / 10) + 1).cast("long")})
    return structure.merge_small(named, "seq").select("doc_id", F.col("island").cast("int").alias("island"), "title", "page_start", "original_count", F.md5("content").alias("digest"))


@operator(
    f"""WITH {NUMBERED}, c AS (SELECT doc_id, line_no, page, CASE WHEN header AND (line_no // 7) % 2 = 0 THEN line END AS chapter FROM numbered)
    SELECT doc_id, line_no, page, last_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS current_chapter FROM c"""
)
def w5_current_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_sections(lines(spark, sf_dir)).withColumn("chapter", F.when(F.col("header") & (F.pmod(F.floor(F.col("line_no") / 7), F.lit(2)) == 0), F.col("line")))
    return scan.fill_forward(rows, "chapter", "current_chapter", ["doc_id"], ["line_no"]).select("doc_id", "line_no", "page", "current_chapter")


@operator(
    f"""WITH {LINES}, p AS (SELECT DISTINCT doc_id, page FROM lines WHERE contains(line, 'WARNING') AND (doc_id + page) % 3 <> 0),
    k AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM p)
    SELECT doc_id, min(page) AS "first", max(page) AS "last", count(*) AS length FROM k GROUP BY doc_id, k"""
)
def w4_t17_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lines(spark, sf_dir).where(F.contains("line", F.lit("WARNING")) & (F.pmod(F.col("doc_id") + F.col("page"), F.lit(3)) != 0))
    return structure.runs(pages, ["doc_id"], "page")


@operator(
    f"""WITH {SECTIONS}, l AS (SELECT doc_id, page_start AS page, max(section_no) AS sec FROM sections WHERE section_no % 2 = 1 GROUP BY ALL),
    p AS (SELECT DISTINCT doc_id, page FROM lines)
    SELECT p.doc_id, p.page, l.sec AS section_no FROM p ASOF LEFT JOIN l ON p.doc_id = l.doc_id AND p.page >= l.page"""
)
def j18_w6_page_to_section_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lines(spark, sf_dir).select("doc_id", "page").distinct()
    mapped = sections(spark, sf_dir).where("section_no % 2 = 1").groupBy("doc_id", F.col("page_start").alias("page")).agg(F.max("section_no").alias("section_no"))
    return structure.as_of(pages, mapped, ["doc_id"], "page", "section_no")


TOC_LINES = """toc AS (SELECT doc_id, line_no, page, CASE line_no % 5
    WHEN 0 THEN 'Chapter ' || (line_no + 1) || ' - Part of ' || doc_id || ' ........ ' || (page + 3)
    WHEN 1 THEN (line_no + 1) || '.' || (doc_id % 4) || ' Running the plant    ' || (page + 4)
    WHEN 2 THEN 'SAFETY NOTES   ' || (page + 5)
    WHEN 3 THEN (line_no + 1) || '.0 FIRST START AND STOP'
    ELSE 'FIG-3 Pump (1)   7' END AS line FROM lines)"""


@operator(
    f"""WITH {LINES}, {TOC_LINES}
    SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN 'Chapter ' || (line_no + 1) || ' - Part of ' || doc_id WHEN 1 THEN (line_no + 1) || '.' || (doc_id % 4) || ' Running the plant'
      WHEN 2 THEN 'SAFETY NOTES' ELSE (line_no + 1) || '.0 FIRST START AND STOP' END AS title,
      CASE line_no % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS level,
      CASE line_no % 5 WHEN 0 THEN page + 3 WHEN 1 THEN page + 4 WHEN 2 THEN page + 5 ELSE page + 1 END AS toc_page
    FROM toc WHERE line_no % 5 <> 4"""
)
def t8_t9_t10_toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d, p = F.col("line_no"), F.col("doc_id"), F.col("page")
    k = F.pmod(n, F.lit(5))
    line = (
        F.when(k == 0, F.concat(F.lit("Chapter "), n + 1, F.lit(" - Part of "), d, F.lit(" ........ "), p + 3))
        .when(k == 1, F.concat(n + 1, F.lit("."), F.pmod(d, F.lit(4)), F.lit(" Running the plant    "), p + 4))
        .when(k == 2, F.concat(F.lit("SAFETY NOTES   "), p + 5))
        .when(k == 3, F.concat(n + 1, F.lit(".0 FIRST START AND STOP")))
        .otherwise("FIG-3 Pump (1)   7")
    )
    return structure.toc_entries(lines(spark, sf_dir).withColumn("line", line))


@operator(
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Table of Contents' WHEN 1 THEN 'ab' WHEN 2 THEN NULL WHEN 3 THEN 'Index of ' || doc_id WHEN 4 THEN 'Pump P-1' ELSE 'FIG-2 Layout (3)' END AS title FROM documents)
    SELECT doc_id, title, (title IS NULL OR length(trim(title)) < 3 OR regexp_matches(lower(title), 'contents|index')) AS junk, coalesce(regexp_matches(title, '^[A-Z0-9]{2,}-[0-9]+') OR regexp_matches(title, '\([0-9]+\)\s*$'), false) AS noise FROM t"""
)
def p13_p22_junk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("doc_id", F.lit(6))
    title = F.when(k == 0, "Table of Contents").when(k == 1, "ab").when(k == 2, None).when(k == 3, F.concat(F.lit("Index of "), F.col("doc_id"))).when(k == 4, "Pump P-1").otherwise("FIG-2 Layout (3)")
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    return rows.select("doc_id", "title", T.is_junk_title(F.col("title")).alias("junk"), F.coalesce(T.toc_noise(F.col("title")), F.lit(False)).alias("noise"))


@operator(
    r"""SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\x00-\x09\x0B-\x1F]', '', 'g') AS clean,
      CASE WHEN length(text) > 60 THEN regexp_replace(left(text, 60), ' [^ ]*$', '') || '...' ELSE text END AS cut,
      length(text) // 4 AS tokens, left(regexp_replace(text, '[^\p{L}\p{N}_\-.]', '_', 'g'), 100) AS name,
      len(regexp_extract_all(text, '\S+')) AS n_words, md5(text) AS md5, sha256(text) AS sha256, left(text, 500) AS preview FROM documents"""
)
def f1_f16_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.strip_controls(t).alias("clean"), T.cut_at_word(t, 60).alias("cut"), T.token_estimate(t).alias("tokens"), T.safe_name(t).alias("name"),
        F.size(T.words(t)).alias("n_words"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.left(t, F.lit(500)).alias("preview"),
    )


@operator(
    r"""WITH s AS (SELECT doc_id, list_distinct(list_filter(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) ELSE [] END, lambda p: length(p) > 10)) AS p
      FROM (SELECT doc_id, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '\S+') AS w FROM documents))
    SELECT doc_id, len(p) AS phrases, md5(array_to_string(list_sort(p), '|')) AS digest FROM s"""
)
def f22_phrase_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.shingles(F.replace("text", F.lit("ß"), F.lit("ss")))
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", F.size("p").alias("phrases"), F.md5(F.array_join(F.sort_array("p"), "|")).alias("digest"))


@operator(
    """WITH c AS (SELECT doc_id, text, greatest(ceil((length(text) - 400) / 1200.0), 1)::INT AS n FROM documents),
    s AS (SELECT doc_id, text, unnest(range(n))::INT AS "index" FROM c)
    SELECT doc_id, "index", ("index" * 1200)::INT AS char_start, md5(substr(text, "index" * 1200 + 1, 1600)) AS digest FROM s"""
)
def t1_strided_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.strided_chunks(docs).select("doc_id", "index", "char_start", F.md5("chunk").alias("digest"))


@operator()
def t1_t2_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), F.greatest(F.ceil(F.length("text") / 1500), F.lit(1)).cast("int").alias("pages"), "text")
    page = chunking.chunk_page(F.lit(0), F.col("pages") - 1, F.col("char_start"), F.col("char_end"), F.col("chars"))
    return chunking.chunk_documents(docs).select("doc_id", "index", "char_start", "char_end", page.alias("page"), T.token_estimate(F.col("text")).alias("tokens"), F.md5("text").alias("digest"))


@operator(
    """SELECT doc_id, lower(substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (('0x'||substr(h,17,1))::INT % 4) + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12)) AS key,
       substr(sha256(doc_id || ':' || source || ':72.0'), 1, 24) AS short_id
    FROM (SELECT doc_id, source, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || (doc_id || ':' || source || ':NA:1-2')::BLOB) AS h FROM documents)"""
)
def f16_identity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = F.col("doc_id").cast("string"), F.col("source")
    return table(spark, sf_dir, "documents").select("doc_id", ids.section_id(d, s, F.lit(""), F.lit("1"), F.lit("2")).alias("key"), ids.digest_id(d, s, F.lit("72.0")).alias("short_id"))


@operator(
    """SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) ELSE printf('%.1f KB', n_chars / 1024.0::DOUBLE) END AS size,
      round(CASE WHEN n_chars - 500 > 0 THEN n_chars / nullif((n_chars - 500)::DOUBLE, 0) ELSE 0 END, 6) AS ratio FROM documents"""
)
def f17_f28_f29_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.functions import maths as M

    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", T.human_size(n).alias("size"), F.round(M.ratio(n, n - 500), 6).alias("ratio"))


@operator(
    f"""WITH {SECTIONS}, t AS (SELECT doc_id, section_no, lower(content) AS c FROM sections)
    SELECT doc_id, section_no, array_to_string(list_sort(list_filter(['table',
      CASE WHEN regexp_matches(c, 'specification|specs|technical data') THEN 'specifications' END, CASE WHEN regexp_matches(c, 'parts list|part list|components|spare parts') THEN 'parts-list' END,
      CASE WHEN regexp_matches(c, 'parameter|setting|configuration') THEN 'parameters' END, CASE WHEN regexp_matches(c, 'schedule|maintenance|inspection') THEN 'maintenance' END,
      CASE WHEN regexp_matches(c, 'performance|rating|capacity') THEN 'performance' END, CASE WHEN regexp_matches(c, 'fuel|diesel|bunker') THEN 'fuel-system' END,
      CASE WHEN regexp_matches(c, 'cooling|cooler|heat exchanger') THEN 'cooling-system' END, CASE WHEN regexp_matches(c, 'lubrication|lube oil|lub oil') THEN 'lubrication-system' END,
      CASE WHEN regexp_matches(c, 'exhaust|emission') THEN 'exhaust-system' END, CASE WHEN regexp_matches(c, 'starting|air start') THEN 'starting-system' END,
      CASE WHEN contains(c, 'pump') THEN 'pump' END, CASE WHEN contains(c, 'valve') THEN 'valve' END, CASE WHEN regexp_matches(c, 'motor|engine|generator') THEN 'motor-engine' END,
      CASE WHEN regexp_matches(c, 'sensor|gauge|meter|monitor') THEN 'instrumentation' END], lambda x: x IS NOT NULL)), ',') AS tags FROM t"""
)
def t19_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", "section_no", F.array_join(T.tags(F.col("content"), "table"), ",").alias("tags"))


MATRIX = "m AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')) AS m FROM documents)"


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, m: a text's lines as rows of a table, its words as cells."""
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")).alias("m"))


@operator(
    f"""WITH {MATRIX}, s AS (SELECT doc_id, m, list_transform(m, lambda r: len(r)) AS sizes, list_filter(flatten(m), lambda c: trim(c) <> '') AS cells FROM m)
    SELECT doc_id, len(m)::INT AS n_rows, (len(m) >= 2 AND list_max(sizes) - list_min(sizes) <= 0.4 * list_max(sizes) AND list_sum(sizes) >= 2 * len(m) AND len(cells) >= 0.25 * list_sum(sizes)
      AND len(cells) >= 4 AND list_sum(list_transform(cells, lambda c: length(c))) <= 150 * len(cells)) AS valid FROM s"""
)
def p17_valid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices(spark, sf_dir).select("doc_id", F.size("m").alias("n_rows"), chunking.valid_matrix(F.col("m")).alias("valid"))


def padded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, those of five in ten as three words in columns."""
    words, n = T.words(F.col("line")), F.pmod(F.col("line_no"), F.lit(10))
    pad = lambda k, width: F.rpad(F.coalesce(F.get(words, F.lit(k)), F.lit("-")), F.greatest(F.lit(width), F.length(F.coalesce(F.get(words, F.lit(k)), F.lit("-"))) + 2), " ")
    row = F.concat(pad(0, 14), pad(1, 10), F.coalesce(F.get(words, F.lit(2)), F.lit("end")))
    return lines(spark, sf_dir).select("doc_id", "line_no", F.when(n.isin(2, 3, 4, 5, 8), row).otherwise(F.col("line")).alias("line"))


@operator()
def t7_t5_p17_t3_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in the text of pages, whole: columns by gaps, trimmed, tested and packed into chunks."""
    found = text_tables.text_tables(padded_lines(spark, sf_dir), ["doc_id"], most_rows=None, most_columns=None)
    return found.select("doc_id", "first_line", "rows", "cols", F.md5(F.array_join(chunking.table_chunks(F.col("matrix")), "\n\n")).alias("digest"))


@operator()
def t3_t5_table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrices(spark, sf_dir).select("doc_id", F.posexplode(chunking.table_chunks(F.col("m"))).alias("chunk_index", "chunk"))
    return rows.select("doc_id", "chunk_index", F.left("chunk", F.lit(500)).alias("text_preview"), F.length("chunk").alias("text_length"))


@operator()
def t4_s9_s10_csv_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as comma-separated text, in chunks."""
    row = F.concat_ws(",", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey").cast("string")).otherwise(F.lit("")), F.col("l_quantity").cast("int"))
    lines_of = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("r"))
    csv = lines_of.select("l_orderkey", F.concat(F.lit("line,part,supplier,quantity\n"), F.array_join("r", "\n")).alias("csv"))
    return csv.select("l_orderkey", F.posexplode(chunking.record_chunks(F.col("csv"), 100)).alias("chunk_index", "chunk"))


@operator(
    r"""WITH t AS (SELECT doc_id, regexp_replace(string_split(text, chr(10))[1] || ' Page 1 of 2', '\s*[Pp]age\s+[0-9]+\s+of\s+[0-9]+\s*$', '') AS t FROM documents),
    s AS (SELECT doc_id, CASE WHEN regexp_extract(t, '^(.+?[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract(t, '^(.+?[.!?])(?:\s|$)', 1) ELSE t END AS t FROM t),
    h AS (SELECT doc_id, t, left(t, 77) AS h FROM s), c AS (SELECT doc_id, t, CASE WHEN contains(h, ' ') AND length(h) - strpos(reverse(h), ' ') > 40 THEN substr(h, 1, length(h) - strpos(reverse(h), ' ')) ELSE h END AS h FROM h)
    SELECT doc_id, regexp_replace(CASE WHEN length(t) > 80 THEN regexp_replace(h, '[.,;:]+$', '') || '...' ELSE t END, '^\s+|\s+$', '', 'g') AS title FROM c"""
)
def f7_short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document as a title."""
    return table(spark, sf_dir, "documents").select("doc_id", T.short_title(F.concat(F.split("text", "\n")[0], F.lit(" Page 1 of 2"))).alias("title"))


@operator(
    f"""WITH {LINES}, p AS (SELECT DISTINCT doc_id, page, (page - 1) // 50 AS batch FROM lines) SELECT doc_id, batch::INT AS batch, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM p GROUP BY doc_id, batch"""
)
def s1_st3_page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document by fifty. No state is carried from one batch to the next: windows run over the whole document."""
    pages = lines(spark, sf_dir).select("doc_id", "page").distinct().withColumn("batch", F.floor((F.col("page") - 1) / 50).cast("int"))
    return pages.groupBy("doc_id", "batch").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("pages"))


@operator(
    """WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
    SELECT conv_id, turn, role, md5(text) AS digest FROM c WHERE k <= 3"""
)
def w10_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(over)).where("k <= 3").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@operator("""WITH f AS (SELECT text, doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source FROM f WHERE k = 1""")
def w7_u7_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a minimum of narrow rows for each digest, in place of a sort of all texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min(F.struct("doc_id", "source")).alias("f")).select("f.doc_id", "f.source")
