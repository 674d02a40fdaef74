"""Nearest records by cosine distance, for tables of queries.

Records stay where they are and the queries travel to them, as long as the queries are
small (their size is counted first). Larger query tables are cut into blocks, records into
fragments, and each (fragment, block) cell is ranked on its own: exact as well, without
anything passing through the driver. Neither way produces a row per (query, record) pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieverank.operators.blocks import QueryBlock
from sieverank.operators.postings import sparse_topk
from sieverank.session import cut

MAX_BROADCAST_BYTES = 64 << 20
FRAGMENT_BYTES = 64 << 20
BATCH_ROWS = 8_192


def round_distance(distance: Column, decimals: int = 4) -> Column:
    return F.round(distance, decimals)


def rank_within(scored: DataFrame, k: int, query_id: str = "query_id", key: str = "key") -> DataFrame:
    """Rank 1..k per query. Spark limits each partition to k rows per query before the shuffle."""
    order = Window.partitionBy(query_id).orderBy(F.round("distance", 9), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def first_by_key(records: DataFrame, k: int, group: str, key: str) -> DataFrame:
    """The first k keys per group, at distance 0: the answer when there is nothing to rank by."""
    order = Window.partitionBy(group).orderBy(F.col(key))
    return records.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def prefilter_in(vectors: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """Vectors of the surviving keys only. One survivor needs no special case."""
    return vectors.join(survivors.select(key), key, "left_semi")


def _size(queries: DataFrame) -> tuple[int, int]:
    """Bytes of the query table, and bytes per query; one aggregate row comes back."""
    size = F.sum(F.coalesce(F.size("vector"), F.lit(0)) * 8 + 256)
    row = queries.agg(size.alias("bytes"), F.count("*").alias("n")).first()
    total = row["bytes"] or 0
    return total, max(1, total // max(1, row["n"]))


def block_topk(
    records: DataFrame,
    queries: DataFrame,
    k: int,
    key: str,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    fragment_rows: int | None = None,
    block_queries: int | None = None,
    zeros: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, key, distance, rank)``: the k nearest records of every query.

    Features are ``vector``, or ``terms`` and ``weights``, on both sides; the latter are ranked by
    ``sparse_topk``, which tells what ``zeros`` are. With ``sig`` on the
    records and ``mask`` on the queries only records that hold all bits of a query's mask are
    ranked for it. Records without usable features are left out. Fragments and blocks follow
    the width of the features unless they are given.
    """
    if "vector" not in queries.columns:
        return rank_within(sparse_topk(records, queries, k, key, zeros), k).withColumnRenamed("key", key)
    masked = "mask" in queries.columns and "sig" in records.columns
    right = queries.select("query_id", "vector", *(["mask"] if masked else []))
    left = records.select(F.col(key).alias("key"), "vector", *(["sig"] if masked else []))
    schema = _schema(left, right)
    total, each = _size(right)
    if total <= max_broadcast_bytes:
        scored = _near_the_records(left, right, k, schema)
    else:
        scored = grid_topk(
            left.withColumn("cell", F.lit(0)),
            right.withColumn("cell", F.lit(0)),
            k,
            schema,
            fragment_rows or max(1, FRAGMENT_BYTES // each),
            block_queries or max(1, FRAGMENT_BYTES // each),
        )
    return rank_within(scored, k).withColumnRenamed("key", key)


def _schema(left: DataFrame, right: DataFrame) -> str:
    id_type = right.schema["query_id"].dataType.simpleString()
    key_type = left.schema["key"].dataType.simpleString()
    return f"query_id {id_type}, key {key_type}, distance double"


def _near_the_records(left: DataFrame, right: DataFrame, k: int, schema: str) -> DataFrame:
    table = right.toArrow().combine_chunks()
    if table.num_rows == 0:
        return left.sparkSession.createDataFrame([], schema)
    shared = left.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from QueryBlock(shared.value, k).best(batches)

    return left.mapInArrow(run, schema)


def grid_topk(
    left: DataFrame,
    right: DataFrame,
    k: int,
    schema: str,
    fragment_rows: int,
    block_queries: int,
) -> DataFrame:
    """Top-k candidates of queries and records that share a ``cell``.

    A cell with many records or queries is divided: records into fragments, queries into
    blocks, each record meeting each block and the other way round. So no task holds more
    than one fragment and one block, however full a cell is. Both sides are stored once; what is
    known per cell is joined, not broadcast, so there may be any number of cells.
    """
    left, right = cut(left, "records"), cut(right, "queries")
    pieces = cut(
        _divisions(left, "fragments", fragment_rows).join(_divisions(right, "blocks", block_queries), "cell", "full"), "pieces"
    )
    one = F.lit(1).cast("long")
    n_fragments, n_blocks = F.coalesce("fragments", one), F.coalesce("blocks", one)

    def divided(df: DataFrame, own: str, place: Column, other: str, n_other: Column) -> DataFrame:
        sized = df.join(pieces, "cell", "left").withColumn(own, place)
        spread = F.explode(F.sequence(F.lit(0).cast("long"), n_other - 1))
        return sized.withColumn(other, spread).drop("fragments", "blocks")

    record_place = F.pmod(F.xxhash64("key"), n_fragments)
    query_place = F.pmod(F.xxhash64("query_id"), n_blocks)
    cells = ["cell", "fragment", "block"]
    wanted = right.select("cell").distinct()
    records = divided(left.join(wanted, "cell", "left_semi"), "fragment", record_place, "block", n_blocks)
    queries = divided(right, "block", query_place, "fragment", n_fragments)

    nothing = _empty_table(left, right)

    def run(records: pa.Table, queries: pa.Table) -> pa.Table:
        if records.num_rows == 0 or queries.num_rows == 0:
            return nothing
        # Records are ranked batch by batch, so a fragment is never unpacked whole.
        found = list(QueryBlock(queries, k).best(records.combine_chunks().to_batches(BATCH_ROWS)))
        return pa.Table.from_batches(found) if found else nothing

    return records.groupBy(*cells).cogroup(queries.groupBy(*cells)).applyInArrow(run, schema)


def _empty_table(left: DataFrame, right: DataFrame) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.table(
        {
            "query_id": pa.array([], to_arrow_type(right.schema["query_id"].dataType)),
            "key": pa.array([], to_arrow_type(left.schema["key"].dataType)),
            "distance": pa.array([], pa.float64()),
        }
    )


def _divisions(df: DataFrame, name: str, at_most: int) -> DataFrame:
    """``(cell, name)`` for cells above the size: into how many pieces to divide them."""
    sizes = df.groupBy("cell").agg(F.count("*").alias("n"))
    return sizes.filter(F.col("n") > at_most).select(
        "cell", F.ceil(F.col("n") / at_most).cast("long").alias(name)
    )


def knn(queries: DataFrame, vectors: DataFrame, k: int, key: str, **options: int) -> DataFrame:
    """The k nearest vectors of each query vector, with distances as they are reported."""
    ranked = block_topk(vectors, queries, k, key, **options)
    return ranked.withColumn("distance", round_distance(F.col("distance")))


def collection_count(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count("*").alias("n_embedded"))
