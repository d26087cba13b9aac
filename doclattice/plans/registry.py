"""Registry of the reference operators: name -> query, name -> oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclattice.plans import answer_queries, base, figure_queries, fulltext_queries, graph_queries, more_queries, question_queries, search_queries, source_queries, structure_queries  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sections describe a unit, best first."""
    return graph_queries.j3_o3_p24_p26_a23_sections_for_units(spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLE_SQL)
