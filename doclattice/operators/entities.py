"""Entity extraction by dictionary and pattern."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from doclattice.functions.answers import QUALIFIERS
from doclattice.operators import dictionary
from doclattice.operators.small import sent

# What the letters of equipment tags stand for.
PREFIX_TYPES = {
    "P": "pump", "V": "valve", "TK": "tank", "HE": "heat_exchanger", "FLT": "filter", "SEP": "separator",
    "ME": "main_engine", "AE": "auxiliary_engine", "GE": "generator", "C": "compressor", "BLR": "boiler",
}
TAG = r"\b([A-Z]{1,4})[-–]([0-9]{2,4}[A-Z]?)\b"


def equipment_tags(text: Column) -> Column:
    """Distinct tags as array<struct<tag, code, kind>>, sorted."""
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(TAG), F.lit(0))))
    kinds = F.create_map(*(F.lit(x) for kv in PREFIX_TYPES.items() for x in kv))
    prefix = lambda t: F.regexp_extract(t, TAG, 1)
    return F.transform(
        found,
        lambda t: F.struct(t.alias("tag"), F.concat_ws("_", F.lit("eq"), F.lower(prefix(t)), F.lower(F.regexp_extract(t, TAG, 2))).alias("code"), F.coalesce(F.element_at(kinds, prefix(t)), F.lit("equipment")).alias("kind")),
    )


def component_code(kind: Column, name: Column) -> Column:
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", "")), r"\s+", "_")
    return F.left(F.concat_ws("_", F.lit("comp"), kind, clean), F.lit(40))


def dictionary_hits(texts: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """key, code of every keyword that a text holds, in lower case and as a substring. keywords: keyword, code, of any number."""
    found = dictionary.keyword_hits(texts.select(key, F.lower(text).alias("low")), key, "low", keywords.select("keyword"))
    return found.join(sent(keywords), "keyword").select(key, "code").distinct()


# Names that are too general to be looked for in a question.
GENERAL = [
    "valve", "pump", "filter", "cooler", "pipe", "tank", "sensor", "motor", "fan", "alarm", "switch", "gauge", "system", "unit",
    "cylinder", "piston", "bearing", "seal", "gasket", "bolt", "engine", "turbocharger", "compressor", "generator", "boiler",
]
#: Codes that a question may name though no entity has them.
CODE = r"\b([A-Z]{1,4}[-]?[0-9]{1,5})\b"


def telling_names(names: DataFrame) -> DataFrame:
    """name, low: names that a question can be searched for. Single words count only if they look like codes or are long; of names alike but for their case the first by spelling."""
    n, low = F.col("name"), F.lower("name")
    is_upper = (F.upper(n) == n) & (low != n)
    ok = (F.length(low) >= 3) & ~low.isin(GENERAL) & (F.rlike(n, F.lit("[ -]")) | is_upper | F.rlike(n, F.lit("[0-9]")) | (F.length(n) > 8))
    return names.where(ok).groupBy(low.alias("low")).agg(F.min("name").alias("name"))


def question_entities(questions: DataFrame, key: str, text: str, names: DataFrame, most: int = 5) -> DataFrame:
    """key, name, k: the longest names and codes that a question holds, at most so many; of equal length names by spelling, then codes by place. Null keys and texts have none."""
    asked = questions.where(F.col(key).isNotNull())
    known = telling_names(names)
    hits = dictionary.keyword_hits(asked.select(key, F.lower(text).alias("lowered")), key, "lowered", known.select(F.col("low").alias("keyword")))
    found = hits.join(sent(known), F.col("keyword") == F.col("low")).select(key, "low", "name", F.lit(0).alias("kind"), F.lit(0).alias("at"))
    codes = asked.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(CODE), F.lit(1))).alias("at", "name"))
    codes = codes.select(key, F.lower("name").alias("low"), "name", F.lit(1).alias("kind"), "at")
    first = found.unionByName(codes).groupBy(key, "low").agg(F.min(F.struct("kind", "at", "name")).alias("f"))
    over = Window.partitionBy(key).orderBy(F.length("f.name").desc(), "f.kind", "f.at", "f.name")
    return first.withColumn("k", F.row_number().over(over)).where(F.col("k") <= most).select(key, F.col("f.name").alias("name"), "k")


COMPONENTS = ArrayType(
    StructType([StructField("name", StringType()), StructField("kind", StringType()), StructField("code", StringType()), StructField("position", IntegerType())])
)


class ComponentFinder:
    """Components in texts. patterns: (kind, pattern) by priority; a component is a match with up to two words before it."""

    def __init__(self, patterns: list[tuple[str, str]]) -> None:
        self.patterns = [(kind, re.compile(rf"\b((?:\w+\s+)?(?:\w+\s+)?){p}s?\b", re.IGNORECASE)) for kind, p in patterns]
        self.qualifiers = frozenset(QUALIFIERS)

    def clean(self, name: str) -> str:
        """As functions.answers.clean_component: the last word after its known qualifiers, three at most."""
        *before, last = name.split() or [""]
        kept = [q for q in before if q.lower() in self.qualifiers or (q.isupper() and len(q) <= 4)]
        out = " ".join([*kept[-3:], last])
        return out if len(out) >= 3 or not before else ""

    def candidates(self, text: str):
        """(start, end, kind, name, code) in order of the patterns and, within one, of the text."""
        for kind, pattern in self.patterns:
            for m in pattern.finditer(text):
                name = self.clean(m[0])
                slug = re.sub(r"\s+", "_", re.sub(r"[^a-z0-9\s]", "", name.lower()).strip())
                yield *m.span(), kind, name, f"comp_{kind}_{slug}"[:40]

    def __call__(self, text: str) -> list[dict]:
        """The candidates, each unless its name is short, its code is known or it overlaps one that came first. Kept spans are disjoint, so in order only two of them can overlap a new one."""
        starts, ends, by_code = [], [], {}
        for start, end, kind, name, code in self.candidates(text):
            k = bisect_left(starts, start)
            apart = (k == 0 or ends[k - 1] <= start) and (k == len(starts) or starts[k] >= end)
            if apart and len(name) >= 3 and code not in by_code:
                starts.insert(k, start)
                ends.insert(k, end)
                by_code[code] = {"name": name, "kind": kind, "code": code, "position": start}
        return list(by_code.values())


def components(patterns: list[tuple[str, str]]):
    @F.pandas_udf(COMPONENTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = ComponentFinder(patterns)
        for texts in batches:
            yield pd.Series([find(t) for t in texts.fillna("")])

    return run
