"""Keywords in texts by an Aho-Corasick automaton, whose work is linear in the text.

The distinct keywords are dealt into shards of about SHARD_BYTES by a hash. Each shard
is sent to the executors (so what is sent at once is bounded whatever the size of the
dictionary) and becomes one automaton for each worker process; the texts are read once for
each shard, in one pass if there is one. Only keywords that a text holds become rows.

A keyword is held where it stands anywhere in the text, also inside of a word; so every text
holds the empty keyword. Null keywords are held by none, and null texts hold none.
"""

from __future__ import annotations

import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords, about, that are sent at once.
SHARD_BYTES = 64 << 20
BUILT: dict[str, object] = {}


def automaton(name: str, words) -> ahocorasick.Automaton | None:
    """The automaton of a broadcast shard, one for each worker process; None for no words."""
    if name not in BUILT:
        BUILT.clear()
        found = ahocorasick.Automaton()
        for w in words.value:
            found.add_word(w, w)
        if len(found):
            found.make_automaton()
        BUILT[name] = found if len(found) else None
    return BUILT[name]


def keyword_hits(texts: DataFrame, key: str, text: str, keywords: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, keyword: each keyword once for each row of texts that holds it. keywords: keyword."""
    words = keywords.where("keyword IS NOT NULL").select("keyword").distinct()
    spark, rows = texts.sparkSession, texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text"))
    size, empty = words.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)), F.count_if(F.col("keyword") == "")).first()
    shards = max(1, -(-size // shard_bytes))
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, keyword string"

    def hits(shard: int) -> DataFrame:
        own = words.where((F.pmod(F.xxhash64("keyword"), F.lit(shards)) == shard) & (F.col("keyword") != ""))
        sent, name = spark.sparkContext.broadcast([r.keyword for r in own.toLocalIterator()]), uuid.uuid4().hex

        def run(batches):
            find = automaton(name, sent)
            for b in batches:
                at, found = [], []
                if find is not None:
                    for i, t in enumerate(b["__text"].to_pylist()):
                        held = {w for _, w in find.iter(t)}
                        at.extend([i] * len(held))
                        found.extend(sorted(held))
                yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=[key, "keyword"])

        return rows.mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, map(hits, range(shards)))
    return found.unionByName(rows.select(key, F.lit("").alias("keyword"))) if empty else found
