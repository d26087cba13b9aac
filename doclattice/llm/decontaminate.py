"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text becomes its words (letters A-Z in lower case, digits and all characters
beyond ASCII), each with a space before and after it, in UTF-8. A test string is
a window of WINDOW consecutive words of a benchmark item, or all words of a
shorter item, in the same form; so it occurs as bytes just where it occurs as
words.

Search, by classes of test strings of like lengths (see CLASSES): with m the
shortest length of the class, the block of BLOCK bytes that ends m bytes after
the place looked at gives a shift, from a table over hashes of blocks, by which
no test string can begin in between; at a shift of 0 the bucket of that block
(the suffixes of the strings' first m bytes) names the test strings, and a direct
comparison decides. Most places of a text are never looked at.

Test strings reach the tasks by a broadcast, in shards of at most SHARD_BYTES of
them, so that what is broadcast is bounded whatever the size of the benchmark;
each shard reads the documents once, and what they find is joined by document.
One shard is one pass without a shuffle.

Handling: a null text, or one without words, has no words and no hits. A null or
wordless benchmark text has no windows. Repeated benchmark rows, and windows that
several items have, count for each of their item_ids once; a null item_id marks
words, but is no item. Repeated documents are rows of their own. Texts of any
length are searched whole. Empty tables: no documents give no rows, no items give
no hits. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.bpe import slices

WINDOW = 10
#: Classes of test strings by bytes: from so many on. Most bytes of a block.
CLASSES, BLOCK = (1, 8, 32), 12
#: Most bytes of test strings in one broadcast.
SHARD_BYTES = 64 << 20
#: Hashes of blocks in the table of shifts, as a power of 2, for each string at least 64.
TABLE_BITS = range(16, 25)
#: To lower case, and a space for what is in no word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """The words of a text, each between spaces; one space if there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The test strings of an item."""
    words = folded(text).split()
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1))] if words else []


class Searcher:
    """The test strings of one class: where each of them begins in a text."""

    def __init__(self, strings: list[bytes], block: int = BLOCK) -> None:
        self.m = min(map(len, strings))
        self.block = b = min(block, max(1, self.m // 2))
        bits = next((k for k in TABLE_BITS if 1 << k >= 64 * len(strings)), TABLE_BITS[-1])
        self.mask = (1 << bits) - 1
        most = min(self.m - b + 1, 255)
        self.shift = bytearray([most]) * (1 << bits)
        self.buckets: dict[bytes, list[bytes]] = {}
        for s in strings:
            for end in range(b, self.m + 1):
                at = hash(s[end - b : end]) & self.mask
                if self.shift[at] > self.m - end:
                    self.shift[at] = self.m - end
            self.buckets.setdefault(s[self.m - b : self.m], []).append(s)

    def find(self, text: bytes):
        """(place, string) of every occurrence."""
        m, b, mask, shift, buckets = self.m, self.block, self.mask, self.shift, self.buckets
        end, n = m, len(text)
        while end <= n:
            block = text[end - b : end]
            step = shift[hash(block) & mask]
            if step:
                end += step
                continue
            for s in buckets.get(block, ()):
                if text.startswith(s, end - m):
                    yield end - m, s
            end += 1


class Benchmark:
    """Test strings with the items that have them. items: (item_id, text)."""

    def __init__(self, strings: dict[bytes, list[str]]) -> None:
        self.items = strings
        self.searchers = []
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62)):
            if own := [s for s in strings if low <= len(s) < high]:
                self.searchers.append(Searcher(own))

    def search(self, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (first, behind the last) inside of occurrences, joined and in order, and the items."""
        found = sorted((at, len(s), s) for searcher in self.searchers for at, s in searcher.find(text))
        items: set[str] = set()
        spans: list[tuple[int, int]] = []
        word = place = 0
        for at, _, s in found:
            word += text.count(b" ", place, at)
            place = at
            items.update(self.items[s])
            end = word + s.count(b" ") - 1
            if spans and word <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((word, end))
        return spans, items


def test_strings(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """string, items (sorted distinct ids as strings), shard: every window once."""
    schema = "item string, string binary"

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                rows = [(i, s) for i, t in zip(part["item"].to_pylist(), part["text"].to_pylist()) for s in set(windows_of(t))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.binary())], names=["item", "string"])

    found = items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, schema)
    distinct = found.groupBy("string").agg(F.sort_array(F.collect_set("item")).alias("items")).checkpoint()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("string") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)), F.lit(0))).first()[0]
    return distinct.withColumn("shard", F.pmod(F.xxhash64("string"), F.lit(max(1, -(-size // shard_bytes)))).cast("int")).withColumn("shards", F.lit(max(1, -(-size // shard_bytes))))


BUILT: dict[str, Benchmark] = {}


def built(data) -> Benchmark:
    """One search for each worker process and broadcast."""
    if data.id not in BUILT:
        BUILT.clear()
        BUILT[data.id] = Benchmark(data.value)
    return BUILT[data.id]


class Sent:
    """A broadcast with a name, for workers to keep what they build from it."""

    def __init__(self, spark, strings: dict[bytes, list[str]]) -> None:
        self.sent, self.id = spark.sparkContext.broadcast(strings), uuid.uuid4().hex

    @property
    def value(self):
        return self.sent.value


def with_hits(docs: DataFrame, data: Sent) -> DataFrame:
    """docs (text and others) with n_words, spans (array<struct<first, behind>>) and items (sorted array<string>) in place of text."""
    stay = [f for f in docs.schema.fields if f.name not in ("text", "n_words", "spans", "items")]
    names = [f.name for f in stay]
    span = pa.struct([("first", pa.int64()), ("behind", pa.int64())])

    def run(batches):
        search = built(data)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = [folded(t) for t in b["text"].to_pylist()]
                found = [search.search(t) for t in texts]
                new = [
                    pa.array([t.count(b" ") - 1 for t in texts], pa.int64()),
                    pa.array([[{"first": a, "behind": z} for a, z in spans] for spans, _ in found], pa.list_(span)),
                    pa.array([sorted(x for x in items if x is not None) for _, items in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*(b[n] for n in names), *new], names=[*names, "n_words", "spans", "items"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stay)
    schema = f"{kept}{', ' if kept else ''}n_words long, spans array<struct<first: long, behind: long>>, items array<string>"
    return docs.select(*names, "text").mapInArrow(run, schema)


def joined_spans(spans):
    """Spans in order, those that touch or overlap joined to one."""

    def put(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.named_struct(F.lit("first"), last["first"], F.lit("behind"), F.greatest(last["behind"], x["behind"]))
        return F.when(last["behind"] >= x["first"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<first: bigint, behind: bigint>>"), put)


def find_windows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, n_words, spans, items of every document. docs: key, text; benchmark: item_id, text."""
    spark = docs.sparkSession
    strings = test_strings(benchmark, shard_bytes)
    first = strings.select("shards").first()
    shards = first[0] if first else 1

    def sent(k: int) -> Sent:
        # At most about shard_bytes of strings and ids.
        return Sent(spark, {bytes(r["string"]): list(r["items"]) for r in strings.where(F.col("shard") == k).select("string", "items").collect()})

    rows = docs.select(key, "text")
    if shards == 1:
        return with_hits(rows, sent(0))
    # A row's number is no name for it after a lost executor; its id and text are. Repeated rows come back by their count.
    named = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    same = [key, "digest"]
    found = with_hits(named.dropDuplicates(same), sent(0))
    for k in range(1, shards):
        found = found.unionByName(with_hits(named.dropDuplicates(same), sent(k)))
    merged = found.groupBy(*same).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counts = named.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    left, right = merged.alias("l"), counts.alias("r")
    both = left.join(right, F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l.digest") == F.col("r.digest")))
    return both.select(F.col(f"l.{key}").alias(key), "n_words", joined_spans(F.col("spans")).alias("spans"), "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def audit(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = find_windows(docs, benchmark, "doc_id", shard_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["behind"] - x["first"])
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", "items"
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without any occurrence, with their columns."""
    hit = find_windows(docs, benchmark, key).where(F.size("spans") > 0).select(key).distinct()
    return docs.join(hit, docs[key].eqNullSafe(hit[key]), "left_anti")
