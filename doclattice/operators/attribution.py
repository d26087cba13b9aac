"""For each answer the contexts that share most of its phrases, exactly, without the pairs that common phrases make.

Phrases are 64-bit hashes; those of contexts that no answer has are left out at once,
and what is left is written once as narrow rows. A phrase that more than HOT contexts
have is hot. In order:

* Candidates: contexts that share a phrase which is not hot; at most HOT for each phrase.
* Exact counts of candidates: their hot phrases are looked up by (context, phrase), a key
  that no phrase makes large.
* Early end: a context that is no candidate can share an answer's hot phrases only. Where the
  k-th best candidate shares more than there are, the answer is settled.
* For the other answers alone, hot phrases are joined with all of their contexts, each
  phrase dealt by salts over many tasks, and counted before they are shuffled.

Ties go to the smaller context key. Null keys and texts share nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.functions import text as T
from doclattice.operators.small import sent
from doclattice.sources.files import written

HOT, SALTS = 1000, 64


def phrases_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(key, F.explode(T.shingle_hashes(F.col(text))).alias("phrase"))


def top_overlaps(answers: DataFrame, contexts: DataFrame, answer_key: str, context_key: str, k: int, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """answer_key, context_key, common, phrases, overlap, k: the k contexts with most of an answer's phrases, one at least. answers: answer; contexts: context; keys are unique."""
    a, c, pair = F.col(answer_key), F.col(context_key), [answer_key, context_key]
    asked = written(phrases_of(answers, answer_key, "answer"))
    held = written(phrases_of(contexts, context_key, "context").join(sent(asked.select("phrase").distinct()), "phrase", "left_semi"))
    many = sent(held.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("phrase", F.lit(True).alias("hot")))  # 1 / hot of the rows at most
    marked = asked.join(many, "phrase", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cold, common = marked.where("NOT hot"), marked.where("hot").drop("hot")

    def ranked(rows: DataFrame) -> DataFrame:
        over = Window.partitionBy(answer_key).orderBy(F.col("common").desc(), c)
        return rows.withColumn("k", F.row_number().over(over)).where(F.col("k") <= k)

    shared = written(cold.join(held, "phrase").groupBy(*pair).agg(F.count(F.lit(1)).alias("cold")))
    more = shared.select(*pair).join(common, answer_key).join(held, [context_key, "phrase"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("more"))
    exact = written(ranked(shared.join(more, pair, "left").select(*pair, (F.col("cold") + F.coalesce("more", F.lit(0))).alias("common"))))
    reached = exact.where(F.col("k") == k).select(answer_key, F.col("common").alias("reached"))
    unsettled = common.groupBy(answer_key).agg(F.count(F.lit(1)).alias("most")).join(reached, answer_key, "left").where(F.col("most") >= F.coalesce("reached", F.lit(0)))
    left = common.join(unsettled.select(answer_key), answer_key, "left_semi")
    salted = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = held.join(many.select("phrase"), "phrase", "left_semi").withColumn("salt", F.pmod(F.xxhash64(context_key), F.lit(salts)).cast("int"))
    rest = salted.join(dealt, ["phrase", "salt"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("common")).join(shared.select(*pair), pair, "left_anti")
    sizes = asked.groupBy(answer_key).agg(F.count(F.lit(1)).alias("phrases"))
    best = ranked(exact.drop("k").unionByName(rest)).join(sent(sizes), answer_key)
    return best.select(a, c, "common", "phrases", (F.col("common") / F.col("phrases")).alias("overlap"), "k")
