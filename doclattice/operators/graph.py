"""Graph operators: paths over edges, hierarchies, upserts, deletes and link rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ancestors(nodes: DataFrame, edges: DataFrame, node: str, most: int = 5) -> DataFrame:
    """node, ancestor, depth along edges (child, parent), up to so many hops; each node is its own at depth 0.

    Unrolled joins: the depth is bounded, so the plan is one pass without iteration.
    """
    found = level = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    for k in range(1, most + 1):
        level = level.join(edges, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), F.lit(k).alias("depth"))
        found = found.unionByName(level)
    return found


def longest_path(paths: DataFrame) -> DataFrame:
    """Of each node the ancestor of the greatest depth."""
    return paths.groupBy("node").agg(F.max_by("ancestor", F.struct("depth", "ancestor")).alias("top"), F.max("depth").alias("depth"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected: each edge in both directions, once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """MERGE by key: a new value that is not null replaces the old one; unknown keys are added."""
    rest = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest)
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """Each edge once."""
    return edges.dropDuplicates(["src", "dst"])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, key: str, end: str) -> DataFrame:
    """Nodes that no edge has at that end."""
    return nodes.join(edges.select(F.col(end).alias(key)).distinct(), key, "left_anti")


def neighbours(rows: DataFrame, by: list[str], at: str, value: str, reach: int = 1) -> DataFrame:
    """The values of rows within so many steps of ``at`` (by value, so gaps count), in order."""
    over = Window.partitionBy(*by).orderBy(at).rangeBetween(-reach, reach)
    near = F.transform(F.sort_array(F.collect_list(F.struct(at, value)).over(over)), lambda x: x[value])
    return rows.withColumn("around", near)


def trim_overlaps(chunks: DataFrame, by: list[str], start: str, end: str, text: str) -> DataFrame:
    """Chunks in order of start, joined to one text; what an earlier chunk has covered is cut from the front."""
    over = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(over), F.lit(0))
    cut = chunks.withColumn("new", F.substring(text, F.greatest(reached - F.col(start), F.lit(0)) + 1, F.length(text)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(start, end, "new"))), lambda x: x["new"])
    return cut.groupBy(*by).agg(F.array_join(parts, "").alias("text"))
