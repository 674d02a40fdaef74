"""SimHash near-duplicates: meet-in-the-middle ball hashing over 64-bit fingerprints.

Every distinct fingerprint emits all variants within half the radius, the variants are shuffled,
and fingerprints that meet on a variant are linked to the smallest of them. Fingerprints are made
distinct first, so a variant meets at most as many fingerprints as its ball holds, whatever the
size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.llm.components import smallest_reachable
from sieverank.operators.joins import join_hot
from sieverank.session import cut

_STEP = 100_000


def fingerprints_of(column: pa.Array, words_per_shingle: int) -> np.ndarray:
    """One unsigned fingerprint per text."""
    words, starts = texts.split_words(column)
    counts = np.diff(starts)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(words_list(words), " ").to_numpy(zero_copy_only=False) if len(words) else [""]
    data = joined[0].encode()
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    shingles = np.where(counts > 0, np.maximum(counts - words_per_shingle + 1, 1), 0)
    offsets = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(counts)), shingles)
    first = np.repeat(starts[:-1] - offsets[:-1], shingles) + np.arange(offsets[-1])
    last = np.minimum(first + words_per_shingle, starts[1:][owner]) - 1
    sums = np.zeros((len(counts), 64), np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, int(offsets[-1]), _STEP):
        here = slice(at, at + _STEP)
        spans = zip(begins[first[here]].tolist(), ends[last[here]].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(data[a:b], 42) for a, b in spans]), np.uint8)
        bits = np.unpackbits(hashes).reshape(-1, 64)
        docs, heads = np.unique(owner[here], return_index=True)
        sums[docs] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > shingles[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def words_list(words: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)


def fingerprints(documents: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long; a text without words has zero."""
    texts.prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 19):
            prints = fingerprints_of(block.column("text"), words_per_shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_hash"), pa.array(prints)], ["doc_id", "text_hash", "print"])

    return texts.with_text(documents).withColumn("text_hash", text_hash()).mapInArrow(run, "doc_id long, text_hash long, print long")


def masks(radius: int) -> list[int]:
    """All 64-bit words with up to ``radius`` bits set, as signed longs."""
    words = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(64), n)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def links(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints ``print`` within the distance.

    The distance must be even, 4 at most: then all that meet on a variant lie within it of each
    other, and a link of each to the smallest joins the same components as all pairs do.
    """
    if max_distance not in (0, 2, 4):
        raise ValueError("max_distance has to be 0, 2 or 4")
    ball = F.array(*[F.lit(m).cast("long") for m in masks(max_distance // 2)])
    variants = prints.select("print", F.explode(ball).alias("mask")).select(
        "print", F.col("print").bitwiseXOR(F.col("mask")).alias("variant")
    )
    smallest = F.min("print").over(Window.partitionBy("variant"))
    met = variants.withColumn("least", smallest).filter("print != least")
    return (
        met.select(F.col("print").alias("a"), F.col("least").alias("b"))
        .distinct()
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    )


def text_hash(text: str = "text") -> Column:
    """What tells apart texts that share an id."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _components(documents: DataFrame, words_per_shingle: int, max_distance: int) -> DataFrame:
    """(doc_id, text_hash, print, first) per row; ``first`` has the smallest doc_id of the component, with its text_hash."""
    marked = cut(fingerprints(documents, words_per_shingle), "fingerprints")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    found = cut(marked.groupBy("print").agg(F.min(named).alias("own"), F.count("*").alias("copies")), "distinct")
    joined = cut(links(found.select("print"), max_distance), "near")
    # Fingerprints that have a link are labelled by fingerprints, which are unique; ids need not be.
    linked = joined.select(F.col("a").alias("node")).union(joined.select(F.col("b").alias("node"))).distinct()
    roots = smallest_reachable(linked.withColumn("label", F.col("node")), joined)
    roots = cut(roots.select(F.col("node").alias("print"), F.col("label").alias("root")), "roots")
    firsts = found.join(roots, "print").groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("prints"))
    shared = join_hot(roots, firsts, on="root", copies="prints", spread_by="print").select("print", "first", F.lit(True).alias("is_linked"))
    first = F.when(F.col("is_linked"), F.col("first")).otherwise(F.col("own")).alias("first")
    labels = found.join(shared, "print", "left").select("print", "copies", first)
    return join_hot(marked, labels, on="print", copies="copies", spread_by="doc_id").select("doc_id", "text_hash", "print", "first")


def near_duplicates(documents: DataFrame, words_per_shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``fingerprint``: 16 hex digits; ``component_id``: the smallest doc_id reachable over fingerprints
    that differ in up to ``max_distance`` bits. Null and blank texts share fingerprint zero and are
    linked like others; repeated rows are returned repeatedly; rows that share an id but no fingerprint are
    not linked by the id; a null doc_id counts for no component, and is null for a component without any
    id. An empty table gives no rows. Other columns take no part.
    """
    found = _components(documents, words_per_shingle, max_distance)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def keep_one(documents: DataFrame, words_per_shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """The documents that are first of their component, with all their columns.

    First is the smallest id, and of texts that share it the one with the smallest hash; of rows with equal id and
    text one stays. Rows are told apart by id and text, so a text goes only if one of its own component
    stays. Rows without id cannot be named and stay.
    """
    found = _components(documents, words_per_shingle, max_distance).filter("doc_id is not null")
    gone = found.filter(F.struct("doc_id", "text_hash") != F.col("first")).select(
        F.col("doc_id").alias("__sieverank_gone"), F.col("text_hash").alias("__sieverank_gone_hash")
    ).distinct()
    named = documents.filter("doc_id is not null").withColumn("__sieverank_hash", text_hash())
    same = (named["doc_id"] == gone["__sieverank_gone"]) & (named["__sieverank_hash"] == gone["__sieverank_gone_hash"])
    kept = named.join(gone, same, "left_anti").dropDuplicates(["doc_id", "__sieverank_hash"]).drop("__sieverank_hash")
    return kept.unionByName(documents.filter("doc_id is null"))
