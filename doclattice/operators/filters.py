"""Predicates built from optional parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_filter(rows: DataFrame, equal: dict | None = None, among: dict | None = None, unlike: dict | None = None) -> DataFrame:
    """Conjunction of equalities, lists and inequalities; empty values filter nothing."""
    for k, v in (equal or {}).items():
        if v not in (None, ""):
            rows = rows.where(F.col(k) == v)
    for k, v in (among or {}).items():
        if v:
            rows = rows.where(F.col(k).isin(list(v)))
    for k, v in (unlike or {}).items():
        if v not in (None, ""):
            rows = rows.where(F.col(k) != v)
    return rows


def may_access(owner: Column, user: str, role: str) -> Column:
    return F.lit(role == "admin") | (owner == user)


def page_of(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of a sorted result, from 1: offset and limit, so only that page's rows are gathered."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
