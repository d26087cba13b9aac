"""Source divergence audit over term-block dense matrices.

Terms are runs of letters (A-Z in lower case, and characters beyond ASCII). A
language keeps the terms that at least LEAST_DOCS of its documents have. Each
group (language, source), and each language as a whole, gives each kept term the
smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by
f = floor((p - q)^2 / (p + q)).

Counts: each task counts the terms of its documents by group in a bounded table
before anything is shuffled. The kept terms of a language are dealt into blocks
of about BLOCK_TERMS by a hash, its sources into blocks of about BLOCK_SOURCES. A
tile is a term block and a pair of source blocks: dense int64 matrices of sources
by terms, whose pairs are all computed by broadcasting, a few terms at a time
(STRIDE), and summed over the tile's terms. The partial pair matrices of a task are
added there, those of all tasks by Spark. Tiles on the diagonal also keep, for each
group, a heap of its TOP most overrepresented terms; heaps are merged by rank.

A language with most of all documents is as many tiles as it has term blocks. No
task holds a vocabulary, a language or all counts of a group.

Handling: a null text, language or source reads as ''. Every group that occurs
takes part, without terms too; a language without kept terms gives its pairs the
value 0. A language of one source has no pairs. Repeated rows are documents of
their own. Ties go to the smaller item in UTF-8. Shares are exact up to 9 * 10^15
occurrences in a language. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.llm.bpe import slices
from doclattice.llm.near_join import groups_of

LEAST_DOCS, TOP = 10, 10
BLOCK_TERMS, BLOCK_SOURCES, STRIDE = 1024, 64, 1 << 20
#: Most terms of a task's table; a full one is passed on.
MOST_TERMS = 300_000
#: Most rows that are broadcast, by count; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: To lower case, and a space for what is in no term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def small(rows: DataFrame) -> DataFrame:
    """rows (checkpointed, narrow) to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it) of every group; each group also has a row without a term."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    columns = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows_of(tables):
        for (lang, source), (n, held) in tables.items():
            size = len(n) + 1
            # The terms are whole characters of UTF-8, so their bytes are a string column's. held has them in the order of n.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), pa.array([None, *n], pa.binary()).view(pa.string()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *held.values()], pa.int64()),
                ],
                schema=columns,
            )

    def run(batches):
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist()):
                    if (table := tables.get((lang, source))) is None:
                        table = tables[lang, source] = Counter(), Counter()
                    n, held = table
                    found = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
                    n.update(found)
                    held.update(dict.fromkeys(found).keys())
                if sum(len(n) + 1 for n, _ in tables.values()) > MOST_TERMS:
                    yield from rows_of(tables)
                    tables = {}
        yield from rows_of(tables)

    counted = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division in three steps of a thousand."""
    below = total + 2 * terms
    rest, out = count + 2, np.zeros(np.broadcast_shapes(np.shape(count), np.shape(total)), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and of b the sum of the differences of their terms' shares."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, STRIDE // max(1, len(a) * len(b)))
    for k in range(0, a.shape[1], step):
        out += differences(a[:, None, k : k + step], b[None, :, k : k + step]).sum(2)
    return out


def tiles(counts: DataFrame, block_terms: int, block_sources: int, least: int) -> DataFrame:
    """Rows of every tile (lang, i, j, b): its terms with the language's counts (no source), its groups with their totals (no term), and counts of both.

    own: the source's block; v, total: the language's number of terms and their occurrences.
    """
    held = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "n").checkpoint()
    kept = counts.where("term IS NOT NULL").join(held.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).checkpoint()
    sources = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block_sources).cast("int").alias("s"), F.sum("n").alias("total"))
    terms = held.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = sources.join(terms, "lang", "left").select("lang", "s", "total", F.coalesce("v", F.lit(0)).alias("v")).withColumn("blocks", F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1)).cast("int")).checkpoint()
    langs = small(langs)
    term_block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    source_block = F.pmod(F.xxhash64("source"), F.col("s")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["lang", "i", "j", "b", "source", "own", "term", "n", "total", "v"]

    def by_pair(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("own", source_block).withColumn("other", every("s"))
        return at.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*columns)

    of_groups = by_pair(groups.join(langs, "lang").withColumn("term", F.lit(None).cast("string")).withColumn("b", every("blocks")))
    of_counts = by_pair(kept.join(langs, "lang").withColumn("b", term_block))
    of_terms = held.join(langs, "lang").withColumns({"source": F.lit(None).cast("string"), "own": F.lit(None).cast("int"), "b": term_block}).withColumn("i", every("s")).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("s") - 1)))
    return of_groups.unionByName(of_counts).unionByName(of_terms.select(*columns))


class Sums:
    """Partial pair matrices of the tiles of one pair of source blocks, added."""

    def __init__(self) -> None:
        self.of, self.lang, self.sources, self.sum = None, "", ([], []), None

    def add(self, of: tuple, lang: str, sources: tuple[list[str], list[str]], matrix: np.ndarray):
        if of == self.of:
            self.sum += matrix
            return
        yield from self.rows()
        self.of, self.lang, self.sources, self.sum = of, lang, sources, matrix

    def rows(self):
        if self.of is None:
            return
        a, b = self.sources
        for x, values in zip(a, self.sum.tolist()):
            for y, value in zip(b, values):
                # A pair of one block is there twice.
                if x < y or (self.of[1] != self.of[2] and x != y):
                    yield self.lang, x, "pair", y, value


def tile_rows(g: pa.Table, top: int, sums: Sums):
    """Adds a tile to the sums, and gives the rows of sums that are complete and of its heaps: lang, source, part, item, value."""
    lang, i, j, v, total = g["lang"][0].as_py(), g["i"][0].as_py(), g["j"][0].as_py(), g["v"][0].as_py(), g["total"][0].as_py()
    sources, terms, n = g["source"].to_pylist(), g["term"].to_pylist(), g["n"].to_pylist()
    groups = {s: k for s, t, k in zip(sources, terms, n) if t is None}
    whole = {t: k for s, t, k in zip(sources, terms, n) if s is None}
    names, vocabulary = sorted(groups), sorted(whole)
    at, column = {s: k for k, s in enumerate(names)}, {t: k for k, t in enumerate(vocabulary)}
    counts = np.zeros((len(names), len(vocabulary)), np.int64)
    for s, t, k in zip(sources, terms, n):
        if s is not None and t is not None:
            counts[at[s], column[t]] = k
    totals = np.array([groups[s] for s in names], np.int64)
    p = shares(counts, totals[:, None], v) if v else np.zeros((len(names), 0), np.int64)
    yield from sums.add((lang, i, j), lang, (names, names), pair_sums(p, p)) if i == j else two_blocks(g, sums, lang, i, j, names, p)
    if i == j and vocabulary:
        q = shares(np.array([whole[t] for t in vocabulary], np.int64), np.int64(total), v)
        f = differences(p, q[None, :])
        for k, s in enumerate(names):
            over = np.nonzero((counts[k] > 0) & (p[k] > q))[0]
            for value, term in heapq.nsmallest(top, ((-int(f[k, x]), vocabulary[x]) for x in over.tolist())):
                yield lang, s, "term", term, -value


def two_blocks(g: pa.Table, sums: Sums, lang: str, i: int, j: int, names: list[str], p: np.ndarray):
    """The rows of a tile of two source blocks: those of one against those of the other."""
    first = {s for s, o in zip(g["source"].to_pylist(), g["own"].to_pylist()) if s is not None and o == i}
    a, b = [k for k, s in enumerate(names) if s in first], [k for k, s in enumerate(names) if s not in first]
    yield from sums.add((lang, i, j), lang, ([names[k] for k in a], [names[k] for k in b]), pair_sums(p[a], p[b]))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. docs: text, lang, source."""
    found = tiles(term_counts(docs).checkpoint(), block_terms, block_sources, least)
    by = ["lang", "i", "j", "b"]
    columns = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches):
        sums = Sums()
        for g in groups_of(batches, by):
            yield from batch_of(list(tile_rows(g, top, sums)))
        yield from batch_of(list(sums.rows()))

    def batch_of(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns.types)], schema=columns)

    parts = found.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "lang string, source string, part string, item string, value long").checkpoint()
    once = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = once.unionByName(once.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    over = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(over)).unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
