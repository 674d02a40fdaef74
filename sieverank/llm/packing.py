"""Packing into optimal length buckets.

Texts longer than the longest sequence are cut into pieces; a global histogram of piece lengths, at
most one bin per possible length, decides by dynamic programming where bucket boundaries lose the
fewest padded tokens; inside each bucket, batches are filled up to a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieverank.session import cut

MAX_TOKENS = 2048
BUCKETS = 8
BATCH_TOKENS = 65_536
SLICE_ROWS = 20_000


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of up to ``buckets`` buckets with the least padding; ``counts[i]`` pieces have length i.

    Bounds are lengths that occur. With equal padding fewer and smaller bounds win.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    number = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(np.int64)
    # cost of a bucket that holds lengths[i:j], padded to lengths[j - 1]
    best = lengths * number[1:] - tokens[1:]
    cuts = [np.zeros(len(lengths), np.int64)]
    for _ in range(1, min(buckets, len(lengths))):
        now, where = best.copy(), np.zeros(len(lengths), np.int64)
        for j in range(1, len(lengths)):
            i = np.arange(1, j + 1)
            cost = best[i - 1] + lengths[j] * (number[j + 1] - number[i]) - (tokens[j + 1] - tokens[i])
            at = int(cost.argmin())
            if cost[at] < now[j]:
                now[j], where[j] = cost[at], i[at]
        cuts.append(where)
        best = now
    found, j = [], len(lengths)
    for where in reversed(cuts):
        found.append(int(lengths[j - 1]))
        j = int(where[j - 1])
        if j == 0:
            break
    return found[::-1]


def pieces(documents: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, piece, start, n_tokens): each text as pieces of up to ``max_tokens`` words, in order.

    Tokens are runs of characters other than space and 0x09-0x0D. Null and blank texts have no piece.
    """
    word = r"[^\x20\x09-\x0D]+"
    counted = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(word)), F.lit(0)).alias("n")
    )
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / max_tokens).cast("int")))
    return counted.select("doc_id", "n", F.explode(numbers).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * max_tokens).alias("start"),
        F.least(F.lit(max_tokens), F.col("n") - F.col("piece") * max_tokens).cast("int").alias("n_tokens"),
    )


def pack(
    documents: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, batch, row) for every piece of every text.

    ``bucket`` is the padded length, ``batch`` numbers the batches of a bucket, ``row`` the places in a
    batch, which holds as many rows as ``batch_tokens`` pays for (one at least). Only the last batch of a
    bucket is not full. Pieces of a bucket are in the order of slices of the id's hash, and of id
    and piece within a slice; a slice holds some ``SLICE_ROWS`` pieces, so no task numbers a whole
    bucket. Null and blank texts have no token and no row here; equal rows are packed each; a null
    doc_id is packed like any other; an empty table gives no rows; other columns take no part.
    """
    spark = documents.sparkSession
    found = cut(pieces(documents, max_tokens), "pieces")
    histogram = found.groupBy("n_tokens").count().collect()  # one row per length, max_tokens at most
    counts = np.zeros(max_tokens + 1, np.int64)
    for row in histogram:
        counts[row["n_tokens"]] = row["count"]
    bounds = boundaries(counts, buckets)
    slices = max(1, int(counts.sum()) // SLICE_ROWS)
    bucket = F.lit(None).cast("int")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    # Length and piece are in the hash, so that neither a hot id nor rows without one fill a slice.
    part = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(slices))
    placed = found.withColumn("bucket", bucket).withColumn("slice", part)
    order = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket", "slice").count()
    before = sizes.select("bucket", "slice", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket", "slice").orderBy("doc_id", "piece", "n_tokens")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1).join(cut(before, "offsets"), ["bucket", "slice"])
    place, room = F.col("place") + F.col("before"), F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket")))
    return numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket",
        F.floor(place / room).cast("long").alias("batch"), (place % room).cast("int").alias("row"),
    )
