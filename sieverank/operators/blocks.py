"""Top-k of a block of records against a block of queries, in numpy.

Runs inside Arrow tasks. Records arrive in batches; for every query the k best so far are
kept, so a task hands on at most k rows per query, whatever number of records it saw.
Order is by distance rounded to 9 decimals, then by key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

TILE_QUERIES = 256
TILE_ROWS = 4_096


def _unit(matrix: np.ndarray) -> np.ndarray:
    """The rows at length 1, in place and a tile at a time; rows without length become zeros."""
    for start in range(0, len(matrix), TILE_ROWS):
        part = matrix[start : start + TILE_ROWS]
        length = np.sqrt((part * part).sum(axis=1, keepdims=True))
        np.divide(part, length, out=part, where=length != 0)
        part[length[:, 0] == 0] = 0
    return matrix


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have the right width, and which rows these are."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(lengths.max(initial=0))
    kept = np.flatnonzero((lengths == width) & (width > 0))
    flat = column.take(pa.array(kept)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(kept), width), kept


class DenseQueries:
    """Queries given as vectors of equal width."""

    def __init__(self, table: pa.Table, order: np.ndarray):
        matrix, kept = _matrix(_one(table, "vector"))
        if len(kept) != table.num_rows:
            raise ValueError("query vectors are missing or differ in width")
        self.width = matrix.shape[1]
        # Only masks change the order.
        self.unit = _unit(matrix if (order[1:] > order[:-1]).all() else matrix[order])

    def batch(self, batch: pa.RecordBatch) -> tuple[Any, np.ndarray]:
        matrix, kept = _matrix(batch.column("vector"), self.width)
        return _unit(matrix), kept

    def row_blocks(self, prepared: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        for start in range(0, len(rows), TILE_ROWS):
            yield rows[start : start + TILE_ROWS]

    def distances(self, prepared: np.ndarray, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        return 1.0 - self.unit[low:high] @ prepared[rows].T


def _one(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _words(column: pa.Array) -> np.ndarray:
    """Signature or mask words as integers, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class QueryBlock:
    """The query side of a block: identifiers, features and, if given, condition masks."""

    def __init__(self, table: pa.Table, k: int):
        self.k = k
        masks = _words(_one(table, "mask")) if "mask" in table.column_names else None
        n = table.num_rows
        if masks is None:
            order, bounds = np.arange(n), [0, n]
        else:
            order = np.lexsort(masks.T[::-1])
            masks = masks[order]
            change = np.flatnonzero((masks[1:] != masks[:-1]).any(axis=1)) + 1
            bounds = [0, *change.tolist(), n]
        self.ids = _one(table, "query_id").take(pa.array(order))
        self.scorer = DenseQueries(table, order)
        self.tiles = [
            (low, min(low + TILE_QUERIES, end), None if masks is None else masks[low])
            for begin, end in zip(bounds, bounds[1:])
            for low in range(begin, end, TILE_QUERIES)
        ]

    def best(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest records per query over all batches."""
        state: list[Any] = [None] * len(self.tiles)
        key_type = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_type = batch.column("key").type
            batch = batch.take(pc.sort_indices(batch.column("key")))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            prepared, kept = self.scorer.batch(batch)
            words = _words(batch.column("sig")) if "sig" in batch.schema.names else None
            slot = np.arange(len(kept))
            for i, (low, high, mask) in enumerate(self.tiles):
                rows, row_keys = slot, keys[kept]
                if mask is not None:
                    hit = ((words[kept] & mask) == mask).all(axis=1)
                    rows, row_keys = slot[hit], row_keys[hit]
                done = 0
                for part in self.scorer.row_blocks(prepared, rows):
                    distance = self.scorer.distances(prepared, part, low, high)
                    state[i] = _merge(state[i], distance, row_keys[done : done + len(part)], self.k)
                    done += len(part)
        for (low, _, _), found in zip(self.tiles, state):
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays(
                    [
                        self.ids.take(pa.array(found[0] + low)),
                        pa.array(found[2], type=key_type),
                        pa.array(found[1]),
                    ],
                    names=["query_id", "key", "distance"],
                )


def _merge(state: Any, distance: np.ndarray, keys: np.ndarray, k: int) -> Any:
    """Best k of what was kept and a new block; keys of the block are in ascending order."""
    n = len(distance)
    bound = np.full(n, np.inf)
    if state is not None:
        full = np.bincount(state[0], minlength=n) >= k
        np.maximum.at(worst := np.zeros(n), state[0], np.round(state[1], 9))
        bound[full] = worst[full]
    if distance.shape[1] > k and np.isinf(bound).any():
        # nothing to compare with yet: the k-th of the block itself is the bound
        filled = np.where(np.isnan(distance), np.inf, distance)
        kth = np.partition(filled, k - 1, axis=1)[:, k - 1]
        bound = np.minimum(bound, np.round(kth, 9))
    # a rounded distance at the bound may lie just above it before rounding
    row, column = np.nonzero((distance <= bound[:, None] + 1e-9) & (distance < np.inf))
    found = distance[row, column]
    rounded = np.round(found, 9)
    near = rounded <= bound[row]
    tied = np.flatnonzero(rounded == bound[row])
    late = np.arange(len(tied)) - np.searchsorted(row[tied], row[tied]) >= k
    near[tied[late]] = False  # of equal distances only the k lowest keys can count
    new = (row[near], found[near], keys[column[near]])
    if state is not None:
        if not len(new[0]):
            return state
        new = tuple(np.concatenate([a, b]) for a, b in zip(state, new))
    rows, distances, names = new
    order = np.lexsort((pd.factorize(names, sort=True)[0], np.round(distances, 9), rows))
    rows, distances, names = rows[order], distances[order], names[order]
    near = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[near], distances[near], names[near]
