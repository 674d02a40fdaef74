"""Exact top-k by integer inner product: a KD-tree per shard, best-first, with a propagated k-th score.

Vectors are dealt into shards by id. Each shard is split at medians along its widest side into
leaves with tight bounding boxes. A query visits the leaves of a shard in the order of the most that
any vector in the box could score, until that is less than its k-th score so far. The k-th scores go
along from shard to shard inside a cell, and from a first cell of each query to all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.session import cut

SCALE = 256
SHARD_ROWS, LEAF_ROWS = 2048, 64
SHARDS_PER_CELL, BLOCK_QUERIES, BLOCKS_PER_CELL = 4, 1024, 4
LEAST = -(2**62)


def integers(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)) & (F.size(column) > 0), whole)


def exact_dtype(*tables: np.ndarray) -> type:
    """float64 while every inner product is exact in it, otherwise Python integers."""
    sides = [float(np.abs(t.astype(np.float64)).max(initial=0)) for t in tables]
    return np.float64 if sides[0] * sides[1] * tables[0].shape[1] < 2**52 else object


def leaves(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers per leaf, by median splits along the widest side."""
    todo, found = [rows], []
    while todo:
        rows = todo.pop()
        here = points[rows]
        spread = here.max(0).astype(np.float64) - here.min(0)
        if len(rows) <= size or spread.max() == 0:
            found += [rows[i : i + size] for i in range(0, len(rows), size)]
            continue
        side = here[:, int(spread.argmax())]
        order = np.argsort(side, kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return found


def _tree(table: pa.Table) -> pa.Table:
    """One row per shard: vectors in the order of leaves, their ids, and where leaves end."""
    ids = table.column("vec_id").to_numpy()
    vectors = table.column("vector").combine_chunks()
    points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    found = leaves(points, order, LEAF_ROWS)
    rows = np.concatenate(found)
    ends = np.cumsum([len(f) for f in found])
    parts = [points[rows].astype(np.int64).tobytes(), ids[rows].astype(np.int64).tobytes(), ends.astype(np.int64).tobytes()]
    cells = [pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("width", "shard")]
    return pa.table([*cells, *(pa.array([p], pa.binary()) for p in parts)], names=["width", "shard", "points", "ids", "ends"])


def _block(table: pa.Table) -> pa.Table:
    """One row per block of queries."""
    ids = table.column("vec_id").to_numpy()
    points = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    least = table.column("least").to_numpy()
    cells = [pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("width", "block")]
    parts = [x.astype(np.int64).tobytes() for x in (points, ids, least)]
    return pa.table([*cells, *(pa.array([p], pa.binary()) for p in parts)], names=["width", "block", "points", "ids", "least"])


class Search:
    """The k best of a block of queries over the shards it is shown."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int):
        self.points, self.ids, self.k = points, ids, k
        self.least = least.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def shard(self, points: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        kind = exact_dtype(self.points, points)
        queries, table = self.points.astype(kind), points.astype(kind)
        heads = np.concatenate([[0], ends[:-1]])
        low, high = (np.stack([f(table[a:b], 0) for a, b in zip(heads, ends, strict=True)]) for f in (np.min, np.max))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        for q in range(len(queries)):
            for leaf in order[q]:
                if bounds[q, leaf] < self.least[q]:
                    break
                a, b = heads[leaf], ends[leaf]
                scores = table[a:b] @ queries[q]
                spots = np.flatnonzero((scores >= self.least[q]) & (ids[a:b] != self.ids[q]))
                if len(spots):
                    self._take(q, scores[spots], ids[a:b][spots])

    def _take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        merged = self.best[q] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        merged.sort()
        self.best[q] = merged[: self.k]
        if len(self.best[q]) == self.k:
            self.least[q] = max(self.least[q], -self.best[q][-1][0])

    def table(self) -> pa.Table:
        rows = [(int(q), i, min(max(-s, -(2**63)), 2**63 - 1)) for q, best in zip(self.ids, self.best, strict=True) for s, i in best]
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])


def _cells(trees: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each cell, a group of shards and a group of blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        shards = [[np.frombuffer(row[c], np.int64) for c in ("points", "ids", "ends")] for row in left.to_pylist()]
        for row in right.to_pylist():
            points, ids, least = (np.frombuffer(row[c], np.int64) for c in ("points", "ids", "least"))
            search = Search(points.reshape(len(ids), -1), ids, least, k)
            for table, members, ends in shards:
                search.shard(table.reshape(len(members), -1), members, ends)
            found.append(search.table())
        return pa.concat_tables(found) if found else Search(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0), k).table()

    key = ["width", "across", "down"]
    return trees.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for rows whose id is divisible by ``every``.

    Score: integer inner product of floor(scale * x); ties go to the smaller vec_id, and rows that
    repeat an id are candidates each. A query's own id is no candidate; of rows that repeat a
    query's id the smallest vector asks. Vectors that are null or empty, or hold nulls or non-finite
    components, and rows without id take no part; vectors meet those of their own length only. Fewer
    than k candidates give fewer rows; an empty table gives none; other columns take no part.
    """
    spark = vectors.sparkSession
    texts.prepare(spark)
    points = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("vector"))
    points = cut(points.filter("vec_id is not null and vector is not null").withColumn("width", F.size("vector").cast("long")), "vectors")
    asking = points.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("width", "vector")).alias("q"))
    asking = cut(asking.select("vec_id", "q.width", "q.vector"), "queries")
    shards = max(1, points.count() // SHARD_ROWS)
    blocks = max(1, asking.count() // BLOCK_QUERIES)
    across, down = -(-shards // SHARDS_PER_CELL), -(-blocks // BLOCKS_PER_CELL)

    def each(number: int) -> Column:
        # A long, like the numbers that come of hashes: an equal int hashes elsewhere, so cells would miss each other.
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))

    # Repeats of an id would all hash alike: the vector's hash goes along.
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("long")
    trees = points.withColumn("shard", shard).groupBy("width", "shard").applyInArrow(
        _tree, "width long, shard long, points binary, ids binary, ends binary"
    )
    trees = cut(trees, "trees").withColumn("across", F.col("shard") % across)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long")
    schema = "width long, block long, points binary, ids binary, least binary"

    def packed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", block).groupBy("width", "block").applyInArrow(_block, schema).withColumn("down", F.col("block") % down)

    # First cell: each group of blocks meets one group of shards, which gives it k-th scores.
    first = packed(asking.withColumn("least", F.lit(LEAST))).withColumn("across", F.col("down") % across)
    near = cut(_cells(trees.withColumn("down", each(down)).filter(F.col("across") == F.col("down") % across), first, k), "first")
    kth = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    least = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(LEAST))
    known = asking.join(kth, "vec_id", "left").withColumn("least", F.coalesce(least, F.lit(LEAST))).drop("n", "kth")
    rest = packed(known).withColumn("across", each(across)).filter(F.col("across") != F.col("down") % across)
    others = trees.withColumn("down", each(down)).filter(F.col("across") != F.col("down") % across)
    found = near.union(_cells(others, rest, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
