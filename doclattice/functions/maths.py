"""Arithmetic of boxes, vectors and set metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b > 0, a / F.nullif(b.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return ratio(both, area(a) + area(b) - both)


def centre_distance(a: Column, b: Column) -> Column:
    dx = (a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2
    dy = (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def inside(inner: Column, outer: Column, slack: float) -> Column:
    """Whether a box lies in another one widened by a share of its size."""
    dx, dy = (outer["x1"] - outer["x0"]) * slack, (outer["y1"] - outer["y0"]) * slack
    return (inner["x0"] >= outer["x0"] - dx) & (inner["y0"] >= outer["y0"] - dy) & (inner["x1"] <= outer["x1"] + dx) & (inner["y1"] <= outer["y1"] + dy)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is 0."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def set_scores(expected: Column, found: Column) -> Column:
    """precision, recall and f1 of two sets; 1 for two empty ones, recall 1 without expected ones, precision 1 without found ones."""
    e, f = F.array_distinct(expected), F.array_distinct(found)
    hit = F.size(F.array_intersect(e, f))
    p, r = ratio(hit, F.size(f)), ratio(hit, F.size(e))
    one = lambda a, b, c: F.struct(F.lit(float(a)).alias("precision"), F.lit(float(b)).alias("recall"), F.lit(float(c)).alias("f1"))
    return (
        F.when((F.size(e) == 0) & (F.size(f) == 0), one(1, 1, 1))
        .when(F.size(e) == 0, one(0, 1, 0))
        .when(F.size(f) == 0, one(1, 0, 0))
        .otherwise(F.struct(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")))
    )


def citation_scores(expected: Column, found: Column, beta: float = 2.0) -> Column:
    """As set_scores, but with F-beta and some free extras: half as many as are expected, one at least."""
    e, f = F.array_distinct(expected), F.array_distinct(found)
    hit, extra = F.size(F.array_intersect(e, f)), F.size(F.array_except(f, e))
    charged = F.greatest(F.lit(0), extra - F.greatest(F.lit(1), F.floor(F.size(e) * 0.5).cast("int")))
    p, r = F.when(hit + charged > 0, ratio(hit, hit + charged)).otherwise(F.lit(1.0)), ratio(hit, F.size(e))
    one = lambda a, b, c: F.struct(F.lit(float(a)).alias("precision"), F.lit(float(b)).alias("recall"), F.lit(float(c)).alias("fbeta"))
    return (
        F.when((F.size(e) == 0) & (F.size(f) == 0), one(1, 1, 1))
        .when(F.size(e) == 0, one(0.5, 1, 0.67))
        .when(F.size(f) == 0, one(0, 0, 0))
        .otherwise(F.struct(p.alias("precision"), r.alias("recall"), ratio((1 + beta * beta) * p * r, beta * beta * p + r).alias("fbeta")))
    )
