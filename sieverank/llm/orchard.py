"""Vector codes: product codebooks in whole numbers, whose nearest entries are found by Orchard's search.

A vector is cut into equal parts, and each part becomes the number of the nearest entry in the codebook of
its position. Codebooks are fitted by rounds of assigning all vectors and averaging. Every entry has a list of
the other entries of its codebook, nearest first. To find the entry nearest to a part, the search goes along
the list of the best entry so far. Where it meets a better one it goes on along that one's list, skipping
entries seen before, and it stops at an entry more than twice as far from the best one as the part is: by the
triangle inequality no later entry can be as near. So the result is exact, ties to the lower number included.

Each round reads the stored vectors and hands on, per task, one row for every component of the codebooks;
only sums of these, as many as the codebooks have components, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.operators.joins import join_hot
from sieverank.session import cut

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK_ROWS = 16_384


@dataclass(frozen=True)
class Books:
    """The codebooks of all positions: entries (parts x entries x width), and each entry's list of neighbours."""

    entries: np.ndarray
    lists: np.ndarray  # per entry the others of its codebook, nearest first
    quarters: np.ndarray  # their squared distance from it, divided by 4 and rounded up

    @classmethod
    def of(cls, entries: np.ndarray) -> Books:
        between = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(axis=3)
        own = np.eye(entries.shape[1], dtype=bool)
        order = np.argsort(np.where(own, -1, between), axis=2, kind="stable")[:, :, 1:]
        return cls(entries, order, -(-np.take_along_axis(between, order, axis=2) // 4))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For vectors as rows: the entry of each part (rows x parts), and its squared distance."""
        parts, k, width = self.entries.shape
        x = vectors.reshape(-1, width)
        flat, lists, quarters = self.entries.reshape(-1, width), self.lists.reshape(parts * k, -1), self.quarters.reshape(parts * k, -1)
        base = np.tile(np.arange(parts) * k, len(vectors))  # numbers of entries run over all codebooks
        best = base + self._start(vectors).reshape(-1)
        distance = ((x - flat[best]) ** 2).sum(axis=1)
        seen = np.zeros((len(x), k), bool)
        seen[np.arange(len(x)), best - base] = True
        place, going = np.zeros(len(x), np.int64), np.arange(len(x) if k > 1 else 0)
        while len(going):
            at, of = place[going], best[going]
            far = quarters[of, at] > distance[going]  # more than twice as far: squared, more than four times
            going, at, of = going[~far], at[~far], of[~far]
            local = lists[of, at]
            place[going] += 1
            fresh = ~seen[going, local]
            row, local = going[fresh], local[fresh]
            seen[row, local] = True
            entry = base[row] + local
            found = ((x[row] - flat[entry]) ** 2).sum(axis=1)
            better = (found < distance[row]) | ((found == distance[row]) & (entry < best[row]))
            row = row[better]
            best[row], distance[row], place[row] = entry[better], found[better], 0
            going = going[place[going] < k - 1]
        return (best - base).reshape(-1, parts), distance.reshape(-1, parts)

    def _start(self, vectors: np.ndarray) -> np.ndarray:
        """A first guess: the entry whose sum of components is next to the part's."""
        parts, k, width = self.entries.shape
        sums, own = vectors.reshape(-1, parts, width).sum(axis=2), self.entries.sum(axis=2)
        guess = np.empty(sums.shape, np.int64)
        for part in range(parts):
            order = np.argsort(own[part], kind="stable")
            guess[:, part] = order[np.minimum(np.searchsorted(own[part][order], sums[:, part]), k - 1)]
        return guess


def _checked(found: pa.ListArray, parts: int, scale: int) -> tuple[np.ndarray, list]:
    """Which rows are whole vectors, and these as lists of whole numbers."""
    sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(found.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    whole = found.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends[1:]] == wrong[ends[:-1]])
    kept = values[np.repeat(whole, sizes)]
    scaled = np.floor(kept * scale)
    widest = int(sizes[whole].max(initial=0))
    largest = float(np.abs(scaled).max(initial=0))
    if 4 * largest * largest * max(widest, 1) >= 2.0**62 or largest >= 2.0**30:
        raise ValueError(f"a component of {largest / scale:g} is too large: squared distances would not fit 64 bits")
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[whole])), pa.int32()), pa.array(scaled.astype(np.int32)))
    return whole, lists


def whole_numbers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector, width): vectors without nulls and non-finite components, as floor(scale * x).

    A component so large that squared distances would leave 64 bits is refused with a ``ValueError``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, lists = _checked(batch.column("vector"), parts, scale)
            rows = batch.filter(pa.array(whole))
            sizes = pc.list_value_length(lists).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), lists, sizes], ["vec_id", "label", "vector", "width"])

    # labels are compared as texts; the null one is none of them
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return narrow.mapInArrow(run, "vec_id long, label string, vector array<int>, width long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held, rows = [], 0
    for batch in chain_end(batches):
        if batch is not None and batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if held and (batch is None or rows >= BLOCK_ROWS):
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = table.column("vector").combine_chunks().flatten().to_numpy().astype(np.int64)
            yield table, vectors.reshape(table.num_rows, -1)
            held, rows = [], 0


def chain_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def _sums(stored: DataFrame, books: Books) -> DataFrame:
    """(part, entry, place, total, n): sums and counts of the parts nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.entries.shape
        total, n = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for _, vectors in _blocks(batches):
            codes, _ = books.nearest(vectors)
            slots = (codes + np.arange(parts) * k).reshape(-1)
            np.add.at(total, slots, vectors.reshape(-1, width))
            n += np.bincount(slots, minlength=parts * k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "part": np.repeat(used // k, width), "entry": np.repeat(used % k, width), "place": np.tile(np.arange(width), len(used)),
            "total": total[used].reshape(-1), "n": np.repeat(n[used], width),
        })

    found = stored.mapInArrow(run, "part long, entry long, place long, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(stored: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books | None:
    """Codebooks of vectors of one width: from the first rows by id (and vector), then by rounds of averaging."""
    first = stored.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return None
    now = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    for _ in range(rounds):
        now = now.copy()
        for row in _sums(stored, Books.of(now)).collect():  # one row per component of the codebooks
            now[row["part"], row["entry"], row["place"]] = row["total"] // row["n"]
    return Books.of(now)


def encode(stored: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of vectors of the codebooks' width; two hex digits for every 256 of a codebook."""
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([f"{i:0{digits}x}" for i in range(books.entries.shape[1])])
        for table, vectors in _blocks(batches):
            codes, distance = books.nearest(vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), names.take(pa.array(codes.reshape(-1))))
            columns = [*(table.column(c).combine_chunks() for c in ("vec_id", "label")), pc.binary_join(lists, ""), pa.array(distance.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, "vec_id long, label string, code string, error long")


def usual_width(stored: DataFrame, parts: int) -> int:
    """The most frequent width that can be cut into so many parts; the smaller of two."""
    divisible = stored.filter((F.col("width") > 0) & (F.col("width") % parts == 0))
    found = divisible.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    return found["width"] if found else 0


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row per vector without nulls and non-finite components.

    Codebooks are those of the most frequent width that ``parts`` divides. Vectors of any other width, empty ones
    included, have a row with null code and error. Fewer vectors than entries give smaller codebooks. Rows
    that repeat an id are coded each, and are in the order of their vectors where the first ones are
    chosen; rows without id come last there. ``label_error`` sums the error over rows of equal label, nulls
    together. An empty table gives no rows; other columns take no part.
    """
    texts.prepare(vectors.sparkSession)
    stored = cut(whole_numbers(vectors, parts, scale), "vectors")
    width = F.lit(usual_width(stored, parts))
    books = fit(stored.filter(F.col("width") == width), parts, entries, rounds)
    others = stored.filter(F.col("width") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut(encode(stored.filter(F.col("width") == width), books).unionByName(others) if books else others, "codes")
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies"))
    digest: Column = F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest())
    found = join_hot(coded, errors, on="label", copies="copies", spread_by="vec_id")
    return found.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
