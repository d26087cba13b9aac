"""From raw documents to token ids, in stages that each take what the one before kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Handling, in every stage: columns besides those of documents are dropped, so
clashing names of extra ones do no harm; texts of any length are processed whole;
null texts count as empty; an empty table gives no rows. What a stage does with
repeated rows and ties is said there.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.llm import bpe, line_dedup, mixing, near_join, quality_rules
from doclattice.llm.common import prepare, table
from doclattice.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep. Empty texts fail the base rule; repeated rows share one verdict."""
    prepare(spark)
    rules = quality_rules.learn_list(quality_rules.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return quality_rules.apply_list(docs, rules).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines. Copies and repeated rows, which go only after this stage, count as one page. A null source is a host; null texts stay null."""
    prepare(spark)
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS), copies=False)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id, and all documents without words.

    A null doc_id stands for a class only if the class has no other; of repeated rows of a winner any one stays, as they are alike in doc_id and text.
    """
    prepare(spark)
    marked = near_join.with_digest(docs.select(*COLUMNS))
    texts = near_join.near_texts(marked.select("doc_id", "text", "digest"))
    winners = texts.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("w"))
    winners = winners.select(F.col("w.digest").alias("win"), F.col("w.rep").alias("rep")).checkpoint()
    first = (F.col("digest") == F.col("win")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    # Repeated rows of a winner are looked for among narrow rows.
    repeated = marked.select("doc_id", "digest").join(winners, first).groupBy("digest").count().where("count > 1").limit(1).count()
    kept = marked.join(winners, first)
    if repeated:
        kept = kept.dropDuplicates(["digest"])  # combined before they are shuffled, however many there are
    return kept.select(*COLUMNS).unionByName(marked.where("digest IS NULL").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each time that a document is taken.

    Texts without words (null, empty) are never taken. Repeated rows are documents of their own: each of them is placed, among narrow rows, and takes
    the one text that they share. Ties of a position are ordered by text digest and doc_id. An empty table gives no rows.
    """
    prepare(spark)
    # One name for doc_id, source and text, so that dropping repeated rows and joining their places move the texts once.
    of_source = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    marked = docs.select(*COLUMNS).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    named = marked.withColumn("row", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "digest", of_source)))
    sizes = mixing.sized(named, "row").checkpoint()  # narrow rows, so that texts are read once for them
    sources = mixing.source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    places = mixing.placed(mixing.with_taken(mixing.offsets(sizes, sources))).select("row", "position")
    rows = named.dropDuplicates(["row"]).join(places, "row")
    return mixing.sorted_by(rows, "position", "digest", "doc_id").select(*COLUMNS)


def with_rank(docs: DataFrame) -> DataFrame:
    """Adds rank: the row's place, from 0, in the order in which docs was written, by files and rows of them; null where docs isn't read from files.

    One narrow row for each file is sent to the readers.
    """
    try:
        found = docs.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return docs.withColumn("rank", F.lit(None).cast("long"))
    order = Window.orderBy(F.regexp_extract("file", "part-([0-9]+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = found.groupBy("file").agg((F.max("at") + 1).alias("rows")).select("file", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("before"))
    return found.join(F.broadcast(files), "file").withColumn("rank", F.col("before") + F.col("at")).drop("file", "at", "before")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed unsigned 32-bit integers), a digest of what they decode to, and its rank in training order.

    A null text counts as empty. Repeated rows stay, with ranks of their own. An empty table gives no rows.
    """
    prepare(spark)
    data = bpe.tokenizer_data(spark, tokenizer_path("word_bpe_49k.json"))
    return bpe.round_trip_column(with_rank(docs).select(*COLUMNS, "rank"), data, keep=False).select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "rank",
        F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
        "token_ids",
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("BPE", encode)]

#: The learned rules, the forest and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
