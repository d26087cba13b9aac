"""Queries for captions and context of figures, over the texts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.functions import figures
from doclattice.plans.base import LINES, operator
from doclattice.sources.tables import lines

#: A page's text with a caption of some kind in its upper or lower half, or none.
SHOWN = """halves AS (SELECT doc_id, page, string_agg(CASE WHEN line_no % 10 < 5 THEN line END, chr(10) ORDER BY line_no) AS upper_half, string_agg(CASE WHEN line_no % 10 >= 5 THEN line END, chr(10) ORDER BY line_no) AS lower_half FROM lines GROUP BY ALL),
shown AS (SELECT doc_id, page, upper_half, lower_half, CASE (doc_id + page) % 8 WHEN 0 THEN 'FIG. ' || page || '-2: Fuel  line of ' || doc_id WHEN 1 THEN 'Рисунок ' || page || ' Насос ' || doc_id WHEN 2 THEN 'Type : MAXI ' || doc_id
  WHEN 3 THEN 'PRIMARY BLOWER & BURNER ' || doc_id WHEN 4 THEN '<< FIG. S-' || doc_id || ' >>' WHEN 5 THEN 'Figure 1 x' WHEN 6 THEN 'Схема 3.' || page || ' - Клапан' END AS shown FROM halves),
regions AS (SELECT doc_id, page, CASE WHEN doc_id % 2 = 0 THEN concat_ws(chr(10), shown, upper_half) ELSE coalesce(upper_half, '') END AS above, CASE WHEN doc_id % 2 = 1 THEN concat_ws(chr(10), lower_half, shown) ELSE coalesce(lower_half, '') END AS below FROM shown)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, above, below: the texts around a figure of each page, with captions by rule."""
    at = F.col("line_no") % 10 < 5
    half = lambda ok: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("line_no", "line")))), lambda x: x["line"]), "\n"), F.lit(""))
    pages = lines(spark, sf_dir).groupBy("doc_id", "page").agg(half(at).alias("upper_half"), half(~at).alias("lower_half"), F.count_if(~at).alias("lower_lines"))
    k, d, p = (F.col("doc_id") + F.col("page")) % 8, F.col("doc_id"), F.col("page")
    forms = [
        F.concat(F.lit("FIG. "), p, F.lit("-2: Fuel  line of "), d), F.concat(F.lit("Рисунок "), p, F.lit(" Насос "), d), F.concat(F.lit("Type : MAXI "), d), F.concat(F.lit("PRIMARY BLOWER & BURNER "), d),
        F.concat(F.lit("<< FIG. S-"), d, F.lit(" >>")), F.lit("Figure 1 x"), F.concat(F.lit("Схема 3."), p, F.lit(" - Клапан")),
    ]
    shown = F.coalesce(*(F.when(k == i, f) for i, f in enumerate(forms)))
    lower = F.when(F.col("lower_lines") > 0, F.coalesce("lower_half", F.lit("")))
    above = F.when(d % 2 == 0, F.concat_ws("\n", shown, F.coalesce("upper_half", F.lit("")))).otherwise(F.coalesce("upper_half", F.lit("")))
    below = F.when(d % 2 == 1, F.concat_ws("\n", lower, shown)).otherwise(F.coalesce(lower, F.lit("")))
    return pages.select("doc_id", "page", above.alias("above"), below.alias("below"))


def pattern_sql(k: int, region: str) -> str:
    pattern = f"{'(?im)' if k < figures.ANY_CASE else '(?m)'}{figures.CAPTIONS[k]}"
    of = lambda g: f"regexp_replace(regexp_extract({region}, '{pattern}', {g}), '^\\s+|\\s+$', '', 'g')"
    whole = f"'Figure ' || regexp_extract({region}, '{pattern}', 1) || ': ' || {of(2)}" if k < 2 else of(1)
    clean = f"trim(regexp_replace({whole}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches({region}, '{pattern}') AND length({clean}) >= 5 THEN {clean} END"


def title_sql(region: str) -> str:
    lines = f"list_filter(list_transform(string_split({region}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    fits = f"list_filter({lines}[1:3], lambda x: length(x) BETWEEN 8 AND 100 AND ((upper(x) = x AND lower(x) <> x) OR contains(x, ':')))"
    return f"trim(regexp_replace({fits}[1], '\\s+', ' ', 'g'))"


@operator(
    f"WITH {LINES}, {SHOWN} SELECT doc_id, page, coalesce({', '.join(pattern_sql(k, r) for r in ('above', 'below') for k in range(len(figures.CAPTIONS)))}, {title_sql('above')}, {title_sql('below')}, '') AS caption FROM regions"
)
def t27_figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of a figure on each page: five patterns in two alphabets over the text above, then below; then a line like a title."""
    return regions(spark, sf_dir).select("doc_id", "page", figures.find_caption(F.col("above"), F.col("below")).alias("caption"))


PAGE_TEXTS = """pages_of AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) || CASE WHEN (doc_id + page) % 3 = 0 THEN ' The DIAGRAM ' || (doc_id % 9) || ' shows the burner panel (see drawing ' || (doc_id % 9) || '), TK-7 and V12.' ELSE '' END AS text,
  'Figure ' || (doc_id % 9) || ': unit P-' || (100 + doc_id % 37) AS caption FROM lines GROUP BY doc_id, page)"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = F.col("doc_id"), F.col("page")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    more = F.when((d + p) % 3 == 0, F.concat(F.lit(" The DIAGRAM "), d % 9, F.lit(" shows the burner panel (see drawing "), d % 9, F.lit("), TK-7 and V12."))).otherwise("")
    pages = lines(spark, sf_dir).groupBy("doc_id", "page").agg(joined.alias("text"))
    return pages.select("doc_id", "page", F.concat("text", more).alias("text"), F.concat(F.lit("Figure "), d % 9, F.lit(": unit P-"), 100 + d % 37).alias("caption"))


def references_sql(pattern: str) -> str:
    """Matches of a pattern for numbers of one digit, those of the caption's, with 100 characters on both sides."""
    whole = "(?i)" + pattern.replace("{}", "[0-9]")
    found, between = f"regexp_extract_all(text, '{whole}')", f"string_split_regex(text, '{whole}')"
    start = f"list_sum([length(x) for x in {between}[1:i]]) + coalesce(list_sum([length(x) for x in {found}[1:i - 1]]), 0)"
    cut = f"substr(text, greatest(({start}) - 100, 0)::BIGINT + 1, (({start}) + length({found}[i]) + 100 - greatest(({start}) - 100, 0))::BIGINT)"
    clean = f"regexp_replace(trim(regexp_replace({cut}, '\\s+', ' ', 'g')), '[\\x00-\\x09\\x0B-\\x1F]', '', 'g')"
    return f"[{clean} for i in range(1, len({found}) + 1) if contains({found}[i], (doc_id % 9)::VARCHAR)]"


@operator(
    rf"""WITH {LINES}, {PAGE_TEXTS}, r AS (SELECT *, list_concat(list_concat({references_sql(figures.REFERENCES[0])}, {references_sql(figures.REFERENCES[1])}), {references_sql(figures.REFERENCES[2])}) AS refs FROM pages_of),
    o AS (SELECT doc_id, page, text, caption, [refs[i] for i in range(1, len(refs) + 1) if list_position(refs, refs[i]) = i] AS refs, regexp_extract_all(text || ' ' || caption, '{figures.CODE}') AS c FROM r)
    SELECT doc_id, page, len(refs) AS n_references, md5(array_to_string(refs, chr(10))) AS digest,
      concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{t}' END" for t, w in figures.DOMAINS.items())}) AS tags,
      array_to_string(([c[i] for i in range(1, len(c) + 1) if list_position(c, c[i]) = i])[1:10], ',') AS codes FROM o"""
)
def t28_figure_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a figure on each page: references to its number with a hundred characters on both sides, domains and codes of the page's text."""
    number = figures.figure_number(F.col("caption"))
    found = page_texts(spark, sf_dir).withColumn("refs", figures.references(F.col("text"), number))
    codes = figures.entity_codes(F.concat_ws(" ", "text", "caption"))
    return found.select(
        "doc_id", "page", F.size("refs").cast("long").alias("n_references"), F.md5(F.array_join("refs", "\n")).alias("digest"), F.array_join(figures.domain_tags(F.col("text")), ",").alias("tags"), F.array_join(codes, ",").alias("codes")
    )
