"""Registration of queries with their SQL, and SQL for the derived tables."""

from __future__ import annotations

import functools
import os

QUERIES: dict = {}
ORACLE_SQL: dict = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The decorated lines and sections of doclattice.sources.tables in SQL.
LINES = """
raw AS (SELECT doc_id, source, unnest(range(len(l))) AS line_no, unnest(l) AS raw FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT doc_id, source, line_no::INT AS line_no, (line_no // 10 + 1)::INT AS page, CASE
    WHEN line_no % 7 = 0 THEN (line_no // 7 + 1)::VARCHAR || '.' || (doc_id % 3)::VARCHAR || ' OPERATION OF UNIT P-' || (100 + doc_id % 37)::VARCHAR
    WHEN line_no % 7 = 3 THEN raw || ' WARNING: pump P-' || (100 + (doc_id + line_no) % 37)::VARCHAR || ' must be shut, see Figure ' || (doc_id % 9)::VARCHAR || '.'
    ELSE raw END AS line FROM raw)
"""
HEADER = r"""(length(trim(line)) BETWEEN 3 AND 150 AND (
    regexp_matches(trim(line), '^[0-9]+(?:\.[0-9]+)*\s+\S') OR regexp_matches(trim(line), '^(?:CHAPTER|PART|SECTION|APPENDIX)\s+[A-Z0-9]', 'i')
    OR (regexp_matches(trim(line), '^[A-Z][A-Z\s]{10,}$') AND len(regexp_extract_all(trim(line), '\S+')) >= 3)
    OR regexp_matches(trim(line), '^[A-Z][a-zA-Z\s]{3,}:$')
    OR regexp_matches(trim(line), '^(?:INTRODUCTION|DESCRIPTION|OPERATION|MAINTENANCE|INSTALLATION|SPECIFICATIONS?|TECHNICAL DATA|SAFETY|PROCEDURES?|COMPONENTS?|SYSTEMS?|OVERVIEW|GENERAL|PURPOSE|SCOPE)\b', 'i')))"""
NUMBERED = LINES + rf""",
numbered AS (SELECT *, {HEADER} AS header, (sum({HEADER}::INT) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS section_no FROM lines)
"""
SECTIONS = NUMBERED + r""",
gathered AS (SELECT doc_id, source, section_no, coalesce(max(line) FILTER (header), '') AS title, min(page) AS page_start, max(page) AS page_end,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT header), '') AS content FROM numbered GROUP BY doc_id, source, section_no),
sections AS (SELECT *, regexp_extract(trim(title), '^([0-9]+(?:\.[0-9]+)*)', 1) AS number FROM gathered)
"""
BOXES = """
boxes AS (SELECT DISTINCT l_orderkey % 50 AS doc_id, l_orderkey // 50 AS page,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_extendedprice::DECIMAL(12,2)) AS box_id,
    CASE WHEN l_partkey % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, l_discount AS conf,
    l_quantity * 10 AS x0, (l_partkey % 97)::DOUBLE * 8 AS y0,
    l_quantity * 10 + (60 + (l_suppkey % 41)::DOUBLE * 5) AS x1, (l_partkey % 97)::DOUBLE * 8 + (40 + l_linenumber::DOUBLE * 25) AS y1 FROM lineitem)
"""


def operator(sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL where there is any."""

    def register(f):
        @functools.wraps(f)
        def query(spark, sf_dir):
            # Python workers import this package from where the driver has it.
            env = spark.sparkContext.environment
            if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
                env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = query
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return query

    return register
