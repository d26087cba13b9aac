"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each distinct text becomes the set of its 5-word shingles and TREES labels. A
label is the signature of one tree: DEPTH MinHash values of a byte each, the
first one highest, so labels in order are a sorted prefix trie and two texts
meet as deep in it as their labels have leading bytes in common.

Matching starts at whole labels (depth DEPTH) and shortens the matched prefix
byte by byte. At each depth the texts of a trie node are compared exactly: a
pair is compared once, at the greatest depth at which it meets in any tree, in
the first such tree. From the similarities found so far each text estimates its
own recall: a pair of similarity J meets at depth d with probability
p = 1 - (1 - J^d)^TREES, so the links found stand for the sum of 1 / p links.
What was found says nothing of partners that met nowhere, so each text is held to
have one more partner just at the threshold, unseen with the probability of that
depth. A text whose estimate reaches the target nevertheless is settled and looks no
further; pairs of two settled texts are not compared at shorter prefixes, so dense
nodes stay deep. Texts with few or distant partners go on, to the shortest prefix at which a pair
at the threshold itself meets with the target probability (prefix_length). Only
texts that share a node of that depth with another one take part at all.

Bounded work for hot groups: exact copies are one text. Counts of nodes are
aggregated before they are shuffled; nodes with more than HOT_TEXTS texts are
met by a broadcast of those nodes, never by a shuffle on the node. A node with
many texts is cut into blocks by a hash, and each pair of blocks with an
unsettled text is a task group of its own, of at most about BLOCK_TEXTS and
BLOCK_BYTES; similar pairs are never written as rows: a group reports for each
text its number of links and the smallest text of its linked component there.
Components across groups come from alternating large-star and small-star steps
over those edges, cut by checkpoint. As n_links is exact among what meets, m
distinct near copies of one text are compared in m^2 / 2 pairs; they are dealt
over (m / BLOCK_TEXTS)^2 / 2 groups.

Results for texts: digest, rep (smallest doc_id), n (copies), links (similar
documents: other copies, and all copies of similar texts), root (the class).
Texts without words have no shingles and link to nothing, copies of them
included; texts of fewer words than a shingle are one shingle. A null text
counts as empty. A null doc_id never becomes the class id of a class with
others. Repeated rows are copies. Very long texts are one row of a block of
their own. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.bpe import slices, unload
from doclattice.llm.common import WORD, lean

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.998
TREES, DEPTH = 16, 8
BLOCK_TEXTS, BLOCK_BYTES = 512, 8 << 20
#: Most rows (under 40 bytes each) of nodes or digests that are broadcast, by count; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A node with more texts isn't shuffled as a key; there are at most TREES / HOT_TEXTS such nodes for each text.
HOT_TEXTS = 100_000
_ODD = np.random.RandomState(20).randint(1, 2**62, TREES * DEPTH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with at least this probability."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = mixed(h + w[i : len(w) - n + 1 + i]) + np.uint64(i + 1)
    return np.unique(h)


def labels(h: np.ndarray) -> np.ndarray:
    """A label for each tree: the low byte of each of its MinHash values, the first one highest."""
    low = np.full(_ODD.size, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 2048):
        np.minimum(low, (h[a : a + 2048, None] * _ODD).min(0), out=low)
    return (mixed(low) & np.uint64(255)).astype(np.uint8).reshape(TREES, DEPTH).view(">i8").ravel().astype(np.int64)


def meeting(similarity: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """The probability that pairs of this similarity meet in a prefix of that length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def with_digest(docs: DataFrame) -> DataFrame:
    """Adds digest, 16 bytes that stand for the text; null for texts without words."""
    return docs.withColumn("digest", F.when(F.rlike("text", F.lit(WORD)), F.unhex(F.md5("text"))))


def signed_texts(docs: DataFrame) -> DataFrame:
    """digest, rep, n, bytes, labels of every distinct text."""
    schema = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("bytes", pa.int64()), ("labels", pa.list_(pa.int64()))])

    def run(batches):
        unload()
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b["text"].to_pylist()
                found = [labels(shingles(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b["digest"], b["doc_id"], pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(found, schema.field("labels").type)], schema=schema
                )

    signed = docs.where("digest IS NOT NULL").select("digest", "doc_id", "text").mapInArrow(lean(run), "digest binary, doc_id long, bytes long, labels array<long>")
    return signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("labels").alias("labels"))


def prefix(depth: int) -> Column:
    return F.shiftrightunsigned("label", 64 - 8 * depth)


def at_nodes(rows: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """rows joined to nodes (by, their number of rows m, and more; checkpointed). Few nodes are broadcast; else only those of many rows are, and the others are joined by a shuffle."""
    if nodes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(nodes), by)
    hot = nodes.where(F.col("m") > HOT_TEXTS)
    if hot.isEmpty():
        return rows.join(nodes, by)
    cold = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(nodes.where(F.col("m") <= HOT_TEXTS), by)
    return rows.join(F.broadcast(hot), by).unionByName(cold)


def forest(texts: DataFrame, least: int) -> DataFrame:
    """digest, n, bytes, labels, tree, label of the texts that share a node at the shortest prefix with another text."""
    met = texts.select("digest", "n", "bytes", "labels", F.posexplode("labels").alias("tree", "label")).withColumn("prefix", prefix(least))
    nodes = met.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("m")).where("m > 1").checkpoint()
    return at_nodes(met, nodes, ["tree", "prefix"]).drop("prefix", "m")


def groups_of(batches, names: list[str]):
    """Rows of consecutive batches, sorted by names, as one table for each value of names."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows, bool)
        for n in names:
            v = t[n].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.nonzero(new)[0].tolist()]
        for a, z in zip(cuts, cuts[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def first_met(group: pa.Table, depth: int) -> np.ndarray:
    """For each pair of the group whether it meets nowhere deeper, in no earlier tree as deep, and the blocks are the group's."""
    found = np.stack(group["labels"].to_pylist()).astype(np.int64).view(np.uint64)
    at = lambda d: found >> np.uint64(64 - 8 * d)
    tree, block = group["tree"][0].as_py(), group["block"].to_numpy()
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    n = len(found)
    pair = np.triu(np.ones((n, n), bool), 1) if i == j else (block == i)[:, None] & (block == j)[None, :]
    for t in range(tree):
        own = at(depth)[:, t]
        pair &= own[:, None] != own[None, :]
    for t in range(TREES if depth < DEPTH else 0):
        own = at(depth + 1)[:, t]
        pair &= own[:, None] != own[None, :]
    return pair


def similar(sets: list[np.ndarray], pair: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each row the columns among its pairs with at least that Jaccard similarity, and the similarities."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flags, out = np.zeros(ids.max() + 1, np.int32), []
    for a in np.nonzero(pair.any(1))[0].tolist():
        partners = np.nonzero(pair[a])[0]
        partners = partners[np.minimum(sizes[partners], sizes[a]) >= threshold * np.maximum(sizes[partners], sizes[a]) - 1e-9]
        if not len(partners):
            continue
        mine = ids[starts[a] : starts[a + 1]]
        flags[mine] = 1
        if 4 * len(partners) < len(sets):
            both = np.array([flags[ids[starts[b] : starts[b + 1]]].sum() for b in partners])
        else:
            both = np.add.reduceat(flags[ids], starts[:-1])[partners]
        flags[mine] = 0
        hit = both >= threshold * (sizes[a] + sizes[partners] - both) - 1e-9
        if hit.any():
            out.append((a, partners[hit], both[hit] / (sizes[a] + sizes[partners] - both)[hit]))
    return out


def linked(group: pa.Table, depth: int, least: int, threshold: float) -> pa.RecordBatch | None:
    """digest, links, root, pairs and the pairs that those stand for at each depth, of the group's texts with links."""
    sets = [shingles(t) for t in group["text"].to_pylist()]
    n, digest = group["n"].to_numpy(), group["digest"].to_pylist()
    links, pairs, root = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), list(range(len(sets)))
    depths = range(least, DEPTH + 1)
    stand_for = np.zeros((len(depths), len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, partners, similarity in similar(sets, first_met(group, depth), threshold):
        links[a] += n[partners].sum()
        links[partners] += n[a]
        pairs[a] += len(partners)
        pairs[partners] += 1
        for k, d in enumerate(depths):
            more = 1 / meeting(similarity, d)
            stand_for[k, a] += more.sum()
            stand_for[k, partners] += more
        for b in partners.tolist():
            x, y = find(a), find(b)
            if x != y:
                x, y = sorted((x, y), key=digest.__getitem__)
                root[y] = x
    hit = np.nonzero(links)[0].tolist()
    if not hit:
        return None
    columns = {"digest": pa.array([digest[i] for i in hit], pa.binary()), "links": pa.array(links[hit]), "root": pa.array([digest[find(i)] for i in hit], pa.binary()), "pairs": pa.array(pairs[hit])}
    return pa.RecordBatch.from_pydict(columns | {f"at{d}": pa.array(stand_for[k, hit]) for k, d in enumerate(depths)})


def members_at(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (tree, prefix, i, j, block, digest, n, labels) of texts that meet others first at that depth, by pairs of blocks. rows: forest() and open, false for settled texts."""
    rows = rows.withColumn("prefix", prefix(depth))
    below = prefix(min(depth + 1, DEPTH))
    is_open = F.col("open")
    nodes = rows.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("m"), F.count_if(is_open).alias("m_open"), F.sum("bytes").alias("b"), F.sum(F.when(is_open, F.col("bytes")).otherwise(0)).alias("b_open"), F.min(below).alias("first"), F.max(below).alias("last")
    )
    nodes = nodes.where((F.col("m") > 1) & (F.col("m_open") > 0) & (F.lit(depth == DEPTH) | (F.col("first") != F.col("last"))))
    blocks = lambda m, b: F.greatest(F.ceil(m / BLOCK_TEXTS), F.ceil(b / BLOCK_BYTES)).cast("int")
    nodes = nodes.select("tree", "prefix", "m", blocks(F.col("m_open"), F.col("b_open")).alias("opened"), blocks(F.col("m") - F.col("m_open"), F.col("b") - F.col("b_open")).alias("settled")).checkpoint()
    # Blocks of open texts come first; a block of settled ones meets those only.
    own = F.when(is_open, F.pmod(F.xxhash64("digest"), F.col("opened"))).otherwise(F.col("opened") + F.pmod(F.xxhash64("digest"), F.greatest("settled", F.lit(1))))
    others = F.when(is_open, F.col("opened") + F.col("settled")).otherwise(F.col("opened"))
    dealt = at_nodes(rows, nodes, ["tree", "prefix"]).withColumn("block", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (others - 1).cast("int"))))
    paired = dealt.select("tree", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "n", "labels")

    def run(batches):
        unload()
        for g in groups_of(batches, ["tree", "prefix", "i", "j"]):
            pair = first_met(g, depth)
            keep = pair.any(0) | pair.any(1)
            if keep.any():
                yield from g.filter(pa.array(keep)).combine_chunks().to_batches()

    by = ["tree", "prefix", "i", "j"]
    return paired.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(run), paired.schema)


def verified_links(docs: DataFrame, members: DataFrame, depth: int, least: int, threshold: float) -> DataFrame:
    """linked() for each group of members (checkpointed). Of the texts, only the members' are moved, where those are few enough to be named by a broadcast."""
    asked = members.select("digest").distinct()
    texts = docs.where("digest IS NOT NULL").select("digest", "text")
    texts = texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "digest", "left_semi")
    rows = members.join(texts.groupBy("digest").agg(F.first("text").alias("text")), "digest")
    by = ["tree", "prefix", "i", "j"]

    def run(batches):
        unload()
        for g in groups_of(batches, by):
            if (out := linked(g, depth, least, threshold)) is not None:
                yield out

    schema = "digest binary, links long, root binary, pairs long, " + ", ".join(f"at{d} double" for d in range(least, DEPTH + 1))
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(run), schema)


def forest_links(docs: DataFrame, texts: DataFrame, threshold: float, recall: float) -> DataFrame:
    """digest, links, root, by groups: from whole labels to shorter prefixes, until each text's recall is reached."""
    least = prefix_length(threshold, recall)
    trees = forest(texts, least).checkpoint()
    rows, found = trees.withColumn("open", F.lit(True)), None
    for depth in range(DEPTH, least - 1, -1):
        members = members_at(rows, depth).checkpoint()
        if members.isEmpty():  # nobody meets anybody at this depth for the first time
            continue
        new = verified_links(docs, members, depth, least, threshold).checkpoint()
        found = new if found is None else found.unionByName(new)
        if depth > least:
            unseen = float(1 - meeting(np.float64(threshold), depth))
            done = found.groupBy("digest").agg(F.sum("pairs").alias("pairs"), F.sum(f"at{depth}").alias("all")).where(F.col("pairs") >= recall * (F.col("all") + unseen)).select("digest", F.lit(False).alias("go_on")).checkpoint()
            few = done.count() <= BROADCAST_ROWS
            rows = trees.join(F.broadcast(done) if few else done, "digest", "left").withColumn("open", F.coalesce("go_on", F.lit(True))).drop("go_on")
    if found is None:
        return texts.select("digest", F.lit(0).cast("long").alias("links"), F.col("digest").alias("root")).limit(0)
    return found.select("digest", "links", "root")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) from edges (a, b), by large-star and small-star until nothing changes.

    Centres of many edges are met as hot trie nodes are (at_nodes), so that none of them is one task.
    """

    def large(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count(F.lit(1)).alias("m")).checkpoint()
        return at_nodes(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()

    def small(e):
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("m")).checkpoint()
        return at_nodes(down, least, ["a"]).select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = edges.where("a <> b").distinct().checkpoint()
    before = state(edges)
    while before[0]:
        edges = small(large(edges)).checkpoint()
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_texts(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs (doc_id, text, digest) -> digest, rep, n, links, root of every distinct text with words."""
    texts = signed_texts(docs).checkpoint()
    found = forest_links(docs, texts, threshold, recall)
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("digest"), "root")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    joined = texts.select("digest", "rep", "n").join(links, "digest", "left").join(roots, "digest", "left")
    return joined.select("digest", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "digest").alias("root"))


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_links of every document."""
    marked = with_digest(docs.select("doc_id", "text"))
    texts = near_texts(marked, threshold, recall).checkpoint()
    classes = texts.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = texts.select("digest", "links", "root").join(classes, "root").select("digest", "links", "class_id")
    return marked.select("doc_id", "digest").join(named, "digest", "left").select(
        "doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )
