"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

Rows are sharded into blocks and their vectors into chunks of dimensions. A task
takes a panel of anchors and a panel of rows of one chunk and makes their partial
tile of integer scores; the partial tiles of a pair of blocks are shuffled to one
place and added up, and the tile is reduced there to the best few rows of each
anchor, so that scores of pairs are never rows of a table. Two passes:

* positives: blocks of equal labels alone. A label of many rows is many blocks.
  The best N_POSITIVES of each anchor are left of a tile, and of those of all tiles.
* negatives: all blocks. The anchors' positive scores travel with their panels,
  and the best N_NEGATIVES of other labels inside of each window
  LOWER * positive <= 100 * negative <= UPPER * positive are left of a tile, and
  of all tiles.

A tile holds at most about BLOCK_ANCHORS x BLOCK_ROWS scores, whatever the number
of rows or the size of a label. Products are exact: by floating-point matrix
products where the bound on the sums is below 2^53, else by int64 ones. Anchors
grow with the rows, so work grows with anchors times rows, dealt over as many tiles.

Handling: rows with a null id, label or vector, or a null or non-finite component,
take no part. Of rows with one id the smallest by label, then by components,
counts, so repeated rows count once and an anchor's other rows are those of other
ids. Components are clamped to +-2^27 after scaling. Vectors may differ in length:
missing components count as 0, so an empty vector has the score 0 with all. Ties
of scores go to the smaller id. Empty tables, and anchors without positives or
without rows in a window, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.llm.near_join import groups_of

SCALE, N_POSITIVES, N_NEGATIVES = 256, 5, 10
#: The window in hundredths of the positive's score.
LOWER, UPPER = 30, 90
BLOCK_ANCHORS, BLOCK_ROWS, CHUNK = 256, 2048, 32
MOST_COMPONENT = 1 << 27
#: Most rows of 12 bytes (sizes of labels with more than one block) that are broadcast.
BROADCAST_ROWS = 200_000
TILE = "part long, i int, j int, c int, left_id binary, left_label binary, marks binary, right_id binary, right_label binary, tile binary"


def integer_rows(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, label (long), v (array<int>) of the rows that take part, one for each id."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(MOST_COMPONENT)), F.lit(-MOST_COMPONENT)).cast("int"))
    ok = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~bad)
    taken = ok.select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), whole.alias("v")).alias("row"))
    return taken.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def blocks_of(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """rows with the number of blocks of their part on one side; sizes: those of parts with more than one."""
    renamed = sizes.select(F.col("part"), F.col("blocks").alias(name))
    joined = rows.join(F.broadcast(renamed) if sizes.count() <= BROADCAST_ROWS else renamed, "part", "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(1)))


def panels(left: DataFrame, right: DataFrame, block_left: int, block_right: int, chunk: int) -> DataFrame:
    """part, i, j, c, is_left, id, label, marks, x: every chunk of both sides' vectors, at each tile that asks for it."""

    def sizes(rows: DataFrame, block: int) -> DataFrame:
        return rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1").checkpoint()

    many_left, many_right = sizes(left, block_left), sizes(right, block_right)

    def side(rows: DataFrame, mine: str, other: str, is_left: bool) -> DataFrame:
        both = blocks_of(blocks_of(rows, many_left, "n_i"), many_right, "n_j")
        own = F.pmod(F.xxhash64("id"), F.col(f"n_{mine}")).cast("int")
        at = both.withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        last = F.greatest(F.ceil(F.size("v") / chunk).cast("int") - 1, F.lit(0))
        slices = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("v", c * chunk + 1, chunk))
        cut = at.select("part", "i", "j", F.lit(is_left).alias("is_left"), "id", "label", "marks", F.posexplode(slices).alias("c", "x"))
        # Labels and marks travel with the first chunk.
        return cut.withColumn("marks", F.when(F.col("c") == 0, F.col("marks")))

    return side(left, "i", "j", True).unionByName(side(right, "j", "i", False))


def matrix(x: pa.Array) -> np.ndarray:
    """Slices as rows of a matrix of int64; shorter ones end in zeros."""
    sizes = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed over their common columns, exact."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d and int(np.abs(a).max()) * int(np.abs(b).max()) * d < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def packed_marks(marks: pa.Array, rows: int) -> np.ndarray:
    """rows x (1 + 2 * most): how many marks, their ids, their scores."""
    lists = marks.to_pylist()
    most = max((len(m or ()) for m in lists), default=0)
    out = np.zeros((rows, 1 + 2 * most), np.int64)
    for k, m in enumerate(lists):
        if m:
            out[k, 0] = len(m)
            out[k, 1 : 1 + len(m)] = [x["id"] for x in m]
            out[k, 1 + most : 1 + most + len(m)] = [x["score"] for x in m]
    return out


def partial_tiles(found: DataFrame) -> DataFrame:
    """TILE: the partial scores of each tile and chunk, rows and columns by id."""
    by = ["part", "i", "j", "c"]
    schema = pa.schema(
        [("part", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("c", pa.int32())] + [(n, pa.binary()) for n in ("left_id", "left_label", "marks", "right_id", "right_label", "tile")]
    )

    def run(batches):
        for g in groups_of(batches, by):
            g = g.combine_chunks().sort_by("id")
            is_left = g["is_left"].to_numpy()
            left, right = g.filter(pa.array(is_left)).combine_chunks(), g.filter(pa.array(~is_left)).combine_chunks()
            if not left.num_rows or not right.num_rows:
                continue
            one = lambda t, n: t[n].combine_chunks() if isinstance(t[n], pa.ChunkedArray) else t[n]
            scores = product(matrix(one(left, "x")), matrix(one(right, "x")))
            ids = {f"{s}_{n}": t[n].to_numpy().astype(np.int64) for s, t in (("left", left), ("right", right)) for n in ("id", "label")}
            ids |= {"marks": packed_marks(one(left, "marks"), left.num_rows), "tile": scores}
            yield pa.RecordBatch.from_pydict({n: [g[n][0].as_py()] for n in by} | {n: [v.tobytes()] for n, v in ids.items()}, schema=schema)

    return found.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, TILE)


class Tile:
    """The sum of a tile's partial scores. The first chunk has every row and column; others may lack some."""

    def __init__(self, row: dict) -> None:
        self.key = tuple(row[n] for n in ("part", "i", "j"))
        read = lambda n: np.frombuffer(row[n], np.int64)
        self.left, self.left_label, self.right, self.right_label = read("left_id"), read("left_label"), read("right_id"), read("right_label")
        self.marks = read("marks").reshape(len(self.left), -1)
        self.scores = read("tile").reshape(len(self.left), len(self.right)).copy()

    def add(self, row: dict) -> None:
        left, right = np.frombuffer(row["left_id"], np.int64), np.frombuffer(row["right_id"], np.int64)
        new = np.frombuffer(row["tile"], np.int64).reshape(len(left), len(right))
        if new.shape == self.scores.shape:
            self.scores += new
        else:
            self.scores[np.ix_(np.searchsorted(self.left, left), np.searchsorted(self.right, right))] += new


def added(partial: DataFrame, reduce, schema: str, columns: pa.Schema) -> DataFrame:
    """reduce() of the sum of each tile's partial tiles, one tile in memory at a time."""
    by = ["part", "i", "j"]

    def run(batches):
        tile = None
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b[n][k].as_py() for n in b.schema.names}
                if tile is not None and tile.key == tuple(row[n] for n in by):
                    tile.add(row)
                    continue
                if tile is not None:
                    yield from reduce(tile)
                tile = Tile(row)
        if tile is not None:
            yield from reduce(tile)

    def batches_of(batches):
        for rows in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, columns.types)], schema=columns)

    return partial.repartition(*by).sortWithinPartitions(*by, "c").mapInArrow(batches_of, schema)


def reduce_positives(most: int):
    def reduce(t: Tile):
        order = np.argsort(-t.scores, axis=1, kind="stable")  # columns are in order of id
        out: tuple[list, list, list] = ([], [], [])
        for k, anchor in enumerate(t.left.tolist()):
            best = order[k, : most + 1]
            best = best[t.right[best] != anchor][:most]
            out[0].extend([anchor] * len(best))
            out[1].extend(t.right[best].tolist())
            out[2].extend(t.scores[k, best].tolist())
        yield out

    return reduce


def reduce_negatives(most: int, lower: int, upper: int):
    def reduce(t: Tile):
        width = (t.marks.shape[1] - 1) // 2
        out: tuple[list, ...] = ([], [], [], [], [])
        for k, anchor in enumerate(t.left.tolist()):
            other = np.nonzero(t.right_label != t.left_label[k])[0]
            scores = t.scores[k, other]
            order = np.argsort(-scores, kind="stable")
            ids, down = t.right[other[order]], -scores[order]
            for m in range(t.marks[k, 0]):
                positive, score = t.marks[k, 1 + m], int(t.marks[k, 1 + width + m])
                # lower * score <= 100 * x <= upper * score, x falling
                a = np.searchsorted(down, -((upper * score) // 100), "left")
                z = min(np.searchsorted(down, (-lower * score) // 100, "right"), a + most)
                if a < z:
                    out[0].extend([anchor] * int(z - a))
                    out[1].extend([int(positive)] * int(z - a))
                    out[2].extend([score] * int(z - a))
                    out[3].extend(ids[a:z].tolist())
                    out[4].extend((-down[a:z]).tolist())
        yield out

    return reduce


def best(rows: DataFrame, by: list[str], score: str, key: str, most: int) -> DataFrame:
    """rows with rank, up to so many of each ``by``; what each task holds is cut before rows are exchanged."""
    over = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: int = SCALE,
    block_anchors: int = BLOCK_ANCHORS, block_rows: int = BLOCK_ROWS, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, embedding; is_anchor: a condition on vec_id."""
    whole = integer_rows(rows, scale=scale).checkpoint()
    anchors = whole.withColumn("vec_id", F.col("id")).where(is_anchor).drop("vec_id")
    none = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")

    def tiles(left: DataFrame, right: DataFrame) -> DataFrame:
        return partial_tiles(panels(left, right, block_anchors, block_rows, chunk))

    of_label = lambda x: x.withColumns({"part": F.col("label"), "marks": none})
    first = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
    positives = added(tiles(of_label(anchors), of_label(whole)), reduce_positives(n_positives), "anchor_id long, positive_id long, score long", first)
    marks = best(positives, ["anchor_id"], "score", "positive_id", n_positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score"))).alias("marks"))
    marked = anchors.join(marks.withColumnRenamed("anchor_id", "id"), "id").withColumn("part", F.lit(0).cast("long")).checkpoint()

    second = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])
    everything = whole.withColumns({"part": F.lit(0).cast("long"), "marks": none})
    found = added(tiles(marked, everything), reduce_negatives(n_negatives, lower, upper), ", ".join(f"{n} long" for n in second.names), second)
    ranked = best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
