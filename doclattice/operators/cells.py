"""Approximate nearest neighbours by cells of vectors, with exact scores.

Index: k-means centres (cosine) of a bounded sample of SAMPLE points, at most
MOST_CELLS of them; every point is written with the cell of its nearest centre, each
part of the points in order of cells, in one pass that moves none. Search: each query asks the cells of its nearest centres (probes),
in which its cosines are exact, as blocks of matrix products in one plan; a cell of
very many points is many blocks (search.in_blocks). The number of probes is measured
when the index is built: for TRIED points as queries the exact neighbours are found
among all points, and so many cells are asked as hold the target share of them.

The exact way is search.top_k. Null vectors and those of length 0 are not found and find
nothing. Equal keys are points of their own. An index of no points finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.operators import search

#: Most points that centres are learned from, and most cells.
SAMPLE, MOST_CELLS = 50_000, 4096
#: Points asked to measure the recall, and the share of their neighbours that probes hold.
TRIED, RECALL = 500, 0.95


def nearest_cells(rows: DataFrame, vector: str, centres, most: int) -> DataFrame:
    """rows with cells, the numbers of their nearest centres in order. centres: a broadcast matrix of unit rows (MOST_CELLS at most)."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, cells array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g) and len(centres.value):
                near = np.round(np.stack([np.asarray(v, float) for v in g[vector]]) @ centres.value.T, 12)
                # Of equal ones the first; cells are sorted only where several are asked for.
                order = np.argmax(near, axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most]
                yield g.assign(cells=list(order.astype(np.int32)))

    return rows.mapInPandas(run, schema)


class CellIndex:
    """centres: a broadcast; rows: the points' columns with cell; probes: cells asked for each query."""

    def __init__(self, spark: SparkSession, folder: str, key: str, vector: str, centres, probes: int) -> None:
        self.rows, self.key, self.vector, self.centres, self.probes = spark.read.parquet(folder), key, vector, centres, probes

    def search(self, queries: DataFrame, k: int, floor: float, query_key: str, probes: int | None = None) -> DataFrame:
        """The columns of queries but q and of points but their vector, cell, score, rank. queries: query_key, q."""
        asked = search.unit_vectors(queries.where("q IS NOT NULL"), "q")
        in_cells = nearest_cells(asked, "q", self.centres, probes or self.probes).withColumn("cell", F.explode("cells")).drop("cells")
        found = search.in_blocks(in_cells, self.rows.withColumnRenamed(self.vector, "p"), k, floor, query_key, self.key, by=["cell"])
        return search.best_ranked(found, k, query_key, self.key)


def build(points: DataFrame, key: str, vector: str, folder: str, k: int = 10, cells: int | None = None, sample: int = SAMPLE, tried: int = TRIED, recall: float = RECALL) -> CellIndex:
    """Writes the index of points to a folder that all executors share. k: neighbours for which probes are measured."""
    spark = points.sparkSession
    unit = search.unit_vectors(points.where(F.col(vector).isNotNull()), vector)
    by_hash = (F.xxhash64(key), F.col(key))
    n = unit.count()
    taken = unit.select(key, vector).orderBy(*by_hash).limit(sample).select(array_to_vector(vector).alias("features")).repartition(1).cache()
    many = min(cells or round(n**0.5), MOST_CELLS, n)
    if many > 1:
        found = np.array(KMeans(k=many, distanceMeasure="cosine", maxIter=15, seed=7).fit(taken).clusterCenters())
    else:
        found = np.array([r.features.toArray() for r in taken.take(1)] or np.empty((0, 0)))
    taken.unpersist()
    centres = spark.sparkContext.broadcast(found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300) if len(found) else found)
    dealt = nearest_cells(unit, vector, centres, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    dealt.sortWithinPartitions("cell", key).write.parquet(folder)
    index = CellIndex(spark, folder, key, vector, centres, 1)
    index.probes = measured_probes(index, k, tried, recall) if n else 1
    return index


def measured_probes(index: CellIndex, k: int, tried: int, recall: float) -> int:
    """The cells to ask so that they hold this share of the exact neighbours of so many points."""
    asked = index.rows.orderBy(F.xxhash64(index.key, F.lit(1)), index.key).limit(tried).select(F.col(index.key).alias("__q"), F.col(index.vector).alias("q"))
    exact = search.top_k(asked, index.rows.select(index.key, "cell", F.col(index.vector).alias("p")), k, -1.0, "__q", index.key)
    order = nearest_cells(asked, "q", index.centres, len(index.centres.value)).select("__q", "cells")
    # One row for each number of probes, at most MOST_CELLS.
    needed = exact.join(order, "__q").select(F.array_position("cells", F.col("cell")).alias("probes")).groupBy("probes").agg(F.count(F.lit(1)).alias("n")).orderBy("probes").collect()
    total, held = sum(r.n for r in needed), 0
    for r in needed:
        held += r.n
        if held >= recall * total:
            return int(r.probes)
    return 1


def recall_of(found: DataFrame, exact: DataFrame, query_key: str, point_key: str) -> DataFrame:
    """query_key, neighbours (of the exact way), held (those found too)."""
    both = exact.select(query_key, point_key).join(found.select(query_key, point_key, F.lit(1).alias("hit")), [query_key, point_key], "left")
    return both.groupBy(query_key).agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("held"))
