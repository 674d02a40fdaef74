"""Approximate nearest neighbours: random hyperplanes choose candidates, exact distances rank.

A vector falls into one bucket per hash table; near vectors share buckets more often. Only
records that share a bucket with a query are ranked. Full buckets are divided like any other
cell, so copies of one vector, which all share their buckets, cost no more per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.operators.nearest import FRAGMENT_BYTES, grid_topk, rank_within


def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    """``tables * bits`` directions, the same in every task and every run."""
    n = np.arange(1, tables * bits * dim + 1, dtype=np.float64)
    noise = np.sin(n * 12.9898) * 43758.5453
    return (noise - np.floor(noise) - 0.5).reshape(tables * bits, dim)


def buckets(vector: Column, dim: int, tables: int, bits: int, probes: bool = False) -> Column:
    """Cells of a vector, one per table; with ``probes`` also those one bit away."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = hyperplanes(dim, tables, bits)
        first = np.arange(tables, dtype=np.int64) << bits
        flips = np.array([0, *(1 << np.arange(bits))] if probes else [0], dtype=np.int64)
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
                continue
            side = (np.stack(batch.to_numpy()).astype(np.float64) @ planes.T) >= 0
            codes = side.reshape(len(batch), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            cells = first[None, :, None] + (codes[:, :, None] ^ flips[None, None, :])
            yield pd.Series(list(cells.reshape(len(batch), -1)), index=batch.index)

    return run(vector)


def ann_topk(
    records: DataFrame,
    queries: DataFrame,
    k: int,
    key: str,
    dim: int,
    tables: int = 8,
    bits: int = 8,
    **sizes: int,
) -> DataFrame:
    """``(query_id, key, distance, rank)`` among the candidates of each query.

    Vectors that are not ``dim`` wide have no bucket; ``hybrid.wrong_width`` names such queries.
    """
    each = max(1, FRAGMENT_BYTES // (8 * dim + 256))
    sizes = {"fragment_rows": each, "block_queries": each} | sizes

    def celled(df: DataFrame, name: str, probes: bool) -> DataFrame:
        usable = df.filter(F.size("vector") == dim)
        cells = buckets(F.col("vector"), dim, tables, bits, probes)
        return usable.select(
            F.col(name).alias("key" if name == key else "query_id"),
            F.col("vector").alias("vector"),
            F.explode(cells).alias("cell"),
        )

    left = celled(records, key, False)
    right = celled(queries, "query_id", True)
    id_type = right.schema["query_id"].dataType.simpleString()
    key_type = left.schema["key"].dataType.simpleString()
    schema = f"query_id {id_type}, key {key_type}, distance double"
    found = grid_topk(left, right, k, schema, **sizes)
    once = found.groupBy("query_id", "key").agg(F.min("distance").alias("distance"))
    return rank_within(once, k).withColumnRenamed("key", key)


def recall(approximate: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: the share of the exact results that were found."""
    hit = approximate.select("query_id", key, F.lit(1).alias("found"))
    joined = exact.select("query_id", key).join(hit, ["query_id", key], "left")
    return joined.agg(
        F.count("*").alias("n_exact"),
        F.count("found").alias("n_found"),
        F.round(F.count("found") / F.nullif(F.count("*"), F.lit(0)), 4).alias("recall"),
    )
