"""Vector and full-text search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from doclattice.functions import maths as M
from doclattice.functions import text as T
from doclattice.operators.small import sent


def unit_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Vectors divided by their length; those of length 0 (failed embeddings) go."""
    n = F.sqrt(M.dot(F.col(vector), F.col(vector)))
    return rows.withColumn("__n", n).where("__n > 0").withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.col("__n"))).drop("__n")


#: Rows of a block of query vectors, and of points.
BLOCK_QUERIES, BLOCK_POINTS = 4096, 2048


def in_blocks(queries: DataFrame, points: DataFrame, k: int, floor: float, query_key: str, point_key: str, by: list[str] = (), each: list[str] = (), others: bool = False, blocks: tuple[int, int] = (BLOCK_QUERIES, BLOCK_POINTS)) -> DataFrame:
    """The columns of queries but q and of points but p, and score: for each query vector q the k best points p with equal ``by`` of each pair of blocks.

    Groups of ``by`` (all rows, if there is none) are dealt into blocks by a hash of the keys, and each pair of blocks is a matrix product of its own, in one
    plan whatever the number of queries, of which k points are left for each query and value of ``each``. Vectors of length 0 score 0, as do null ones.
    """
    by = list(by) or ["__all"]
    if by == ["__all"]:
        queries, points = queries.withColumn("__all", F.lit(0)), points.withColumn("__all", F.lit(0))

    def many(rows: DataFrame, block: int, name: str) -> DataFrame:
        counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
        return sent(counted.select(*by, F.ceil(F.col("m") / block).cast("int").alias(name)).persist(StorageLevel.MEMORY_AND_DISK))

    many_q, many_p = many(queries, blocks[0], "__ni"), many(points, blocks[1], "__nj")

    def spread(rows: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        sized = rows.join(many_q, by, "left").join(many_p, by, "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in ("__ni", "__nj")})
        own = F.pmod(F.xxhash64(key), F.col(f"__n{mine}")).cast("int")
        return sized.withColumn(f"__{mine}", own).withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__n{other}") - 1)))

    of_query, of_point = [c for c in queries.columns if c != "q" and c not in by], [c for c in points.columns if c != "p" and c not in by]
    kinds = {f.name: f.dataType for f in [*queries.schema, *points.schema]}
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    head = [*by, "__i", "__j"]
    left = spread(queries, query_key, "i", "j").select(*head, *of_query, *map(null, of_point), F.col("q").cast("array<double>").alias("__v"), F.lit(True).alias("__asks"))
    right = spread(points, point_key, "j", "i").select(*head, *map(null, of_query), *of_point, F.col("p").cast("array<double>").alias("__v"), F.lit(False).alias("__asks"))
    kept = [c for c in by if c != "__all"]
    out = T_.StructType([T_.StructField(c, kinds[c]) for c in (*kept, *of_query, *of_point)] + [T_.StructField("score", T_.DoubleType())])

    def unit(vectors: pd.Series, size: int) -> np.ndarray:
        m = np.stack([np.zeros(size) if v is None or len(v) != size else np.asarray(v, float) for v in vectors])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["__asks"].to_numpy(bool)
        a, b = group[asks], group[~asks].sort_values(point_key)
        sizes = [len(v) for v in group["__v"] if v is not None]
        if a.empty or b.empty or not sizes:
            return pd.DataFrame(columns=out.names)
        # Rounded so that equal vectors tie wherever they stand in a product.
        score = np.round(unit(a["__v"], max(sizes)) @ unit(b["__v"], max(sizes)).T, 12)
        if others:
            score[a[query_key].to_numpy()[:, None] == b[point_key].to_numpy()[None, :]] = -np.inf
        score[score < floor] = -np.inf
        classes = b.groupby(list(each), dropna=False, sort=False).ngroup().to_numpy() if each else np.zeros(len(b), int)
        rows, cols = [], []
        for c in range(classes.max() + 1):
            own = np.nonzero(classes == c)[0]
            s = score[:, own]
            least = np.partition(s, -min(k, len(own)), axis=1)[:, -min(k, len(own))]
            r, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            order = np.lexsort((j, -s[r, j], r))
            r, j = r[order], j[order]
            at = np.arange(len(r)) - np.searchsorted(r, r, "left")
            rows.append(r[at < k])
            cols.append(own[j[at < k]])
        r, j = np.concatenate(rows), np.concatenate(cols)
        found = {c: a[c].to_numpy()[r] for c in (*kept, *of_query)} | {c: b[c].to_numpy()[j] for c in of_point}
        return pd.DataFrame(found | {"score": score[r, j]})

    return left.unionByName(right).groupBy(*head).applyInPandas(run, out)


def best_ranked(rows: DataFrame, k: int, query_key: str, point_key: str, each: list[str] = ()) -> DataFrame:
    """rows with rank, the best k of each query (and value of ``each``); ties by key."""
    over = Window.partitionBy(query_key, *each).orderBy(F.col("score").desc(), F.col(point_key))
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame, points: DataFrame, k: int, floor: float, query_key: str, point_key: str, by: list[str] = (), each: list[str] = (), others: bool = False, blocks: tuple[int, int] = (BLOCK_QUERIES, BLOCK_POINTS)
) -> DataFrame:
    """For each query vector q the k points p of highest cosine of at least the floor; ties by key. each: k points for each value of these. others: not the point of the query's own key.

    The exact way: each query against each point, a block of these at a time (in_blocks), and the best of all blocks by rank.
    """
    return best_ranked(in_blocks(queries, points, k, floor, query_key, point_key, by, each, others, blocks), k, query_key, point_key, each)


def mean_vectors(rows: DataFrame, by: list[str], vector: str, size: int | None = None) -> DataFrame:
    """The plain mean of each group's vectors, place by place: partial sums before the shuffle. size: of the vectors; read from a row if not given."""
    if size is None:
        one = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
        size = one[0] if one else 0
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(size)]
    return rows.groupBy(*by).agg(F.array(*means).alias(vector))


#: Rows of a side of a block of vectors.
BLOCK_VECTORS = 2048
#: Sources of a block that are scored at a time.
SLICE = 128


def top_by_blocks(sources: DataFrame, targets: DataFrame, by: str, source: str, unlike: str, target: str, k: int, block: int = BLOCK_VECTORS) -> DataFrame:
    """by, source, unlike, target, score: for each vector q of sources the k vectors p of targets of highest cosine with an equal ``by`` and another ``unlike``; ties by target.

    A group of many vectors is dealt into blocks, and each pair of blocks is a matrix product of its own, of which k rows for each source are left.
    Sizes of groups are sent where they exceed a block, which a share of 1 / block of the rows at most can.
    """

    def sizes(rows):
        many = rows.groupBy(F.col(by).alias("of")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block).select("of", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
        return sent(many.persist(StorageLevel.MEMORY_AND_DISK))

    def blocks_of(rows, many, name):
        joined = rows.join(many.withColumnRenamed("blocks", name), F.col(by).eqNullSafe(F.col("of")), "left").drop("of")
        return joined.withColumn(name, F.coalesce(name, F.lit(1)))

    many_s, many_t = sizes(sources), sizes(targets)

    def spread(rows, key, mine, own, other, others):
        both = blocks_of(blocks_of(rows, own, "own"), others, "others")
        return both.withColumn(mine, F.pmod(F.xxhash64(key), F.col("own")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("others") - 1)))

    null = lambda c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    left = spread(sources, source, "i", many_s, "j", many_t).select(by, "i", "j", source, unlike, null(target, targets), F.col("q").alias("v"))
    right = spread(targets, target, "j", many_t, "i", many_s).select(by, "i", "j", null(source, sources), unlike, target, F.col("p").alias("v"))
    out = T_.StructType([sources.schema[by], sources.schema[source], T_.StructField(f"of_{unlike}", targets.schema[unlike].dataType), targets.schema[target], T_.StructField("score", T_.DoubleType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        is_source = group[target].isna().to_numpy()
        a, b = group[is_source], group[~is_source].sort_values(target)
        if a.empty or b.empty:
            return pd.DataFrame(columns=out.names)
        unit = lambda vs: np.stack([np.asarray(v, float) for v in vs])
        q, p = unit(a["v"]), unit(b["v"])
        lengths, kinds = np.linalg.norm(p, axis=1)[None, :], b[unlike].to_numpy()[None, :]
        most, scores = [], []
        # A slice of sources at a time, so that what is held does not grow with the square of the block.
        for at in range(0, len(q), SLICE):
            of = slice(at, at + SLICE)
            length = np.linalg.norm(q[of], axis=1)[:, None] * lengths
            score = np.divide(q[of] @ p.T, length, out=np.zeros_like(length), where=length > 0)
            score[a[unlike].to_numpy()[of, None] == kinds] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            most.append(best)
            scores.append(np.take_along_axis(score, best, axis=1))
        best, score = np.concatenate(most), np.concatenate(scores)
        rows, cols = np.repeat(np.arange(len(a)), best.shape[1]), best.ravel()
        found = pd.DataFrame({by: a[by].to_numpy()[rows], source: a[source].to_numpy()[rows], f"of_{unlike}": b[unlike].to_numpy()[cols], target: b[target].to_numpy()[cols], "score": score.ravel()})
        return found[found["score"] > -np.inf]

    each = left.unionByName(right).groupBy(by, "i", "j").applyInPandas(run, out)
    over = Window.partitionBy(by, source).orderBy(F.col("score").desc(), target)
    return each.withColumn("k", F.row_number().over(over)).where(F.col("k") <= k)


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, length: term counts of lower-case ASCII words."""
    words = docs.select(key, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    terms = words.select(key, F.size("words").alias("length"), F.explode("words").alias("term"))
    return terms.groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", "length")


def term_counts(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """key, length, tf0, tf1, ...: narrow rows, kept (in memory or on disk) as statistics and scores both read them, so that texts are read once."""
    low = F.lower(text)
    word = "|".join(query)
    held = docs.select(key, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("length"), F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])(?:{word})(?![a-z0-9])"), F.lit(0)).alias("held"))
    count_of = lambda term: F.size(F.filter("held", lambda w: w == F.lit(term)))
    return held.select(key, "length", *(count_of(t).alias(f"tf{i}") for i, t in enumerate(query))).persist(StorageLevel.MEMORY_AND_DISK)


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents with a query term (terms of ASCII letters and digits in lower case)."""
    sized = term_counts(docs, key, text, query)
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(query))))
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    # The statistics are one row.
    return sized.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).where("score > 0")


def normalised(rows: DataFrame, most: float = 0.4) -> DataFrame:
    """Scores as a share of the highest one (one row, sent to all), times ``most``."""
    top = rows.agg(F.max("score").alias("top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("score", F.least(F.lit(most), M.ratio(F.col("score"), F.col("top")) * most)).drop("top")


def overlap_scores(answers: DataFrame, contexts: DataFrame, answer_key: str, context_key: str) -> DataFrame:
    """For each answer and context the share of the answer's phrases that the context has, where there are any.

    By an inverted join on 64-bit hashes of phrases: pairs without a common phrase are never made. The answers' phrases go to the contexts if they are few enough to be
    sent, so that of the contexts' phrases only common ones are shuffled.
    """
    a = answers.select(answer_key, F.explode(T.shingle_hashes(F.col("answer"))).alias("phrase"))
    c = contexts.select(context_key, F.explode(T.shingle_hashes(F.col("context"))).alias("phrase"))
    sizes = answers.select(answer_key, F.size(T.shingle_hashes(F.col("answer"))).alias("phrases"))
    common = c.join(sent(a), "phrase").groupBy(answer_key, context_key).agg(F.count(F.lit(1)).alias("common"))
    return common.join(sent(sizes), answer_key).withColumn("overlap", F.col("common") / F.col("phrases"))
