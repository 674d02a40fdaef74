"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.session import cut

MAX_BROADCAST_BYTES = 64 << 20
SHARES = 16


def join_hot(left: DataFrame, right: DataFrame, on: str, copies: str, spread_by: str) -> DataFrame:
    """``left`` with the columns of ``right`` looked up by ``on``; unmatched rows keep nulls.

    ``right`` is unique on ``on`` and knows in ``copies`` how many left rows each of its rows meets; it
    is stored once. A key that meets more rows than a share of a mean shuffle partition is hot: its right
    row is repeated under as many salts as it fills such shares, all keys together ``SHARES`` for each
    partition beside one each, and its left rows are spread over them by ``spread_by``. Left rows without a key are
    spread like that too. Only the hot keys and their salts are broadcast, fewer rows than there are shares.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in right.columns if c != on]
    stored = cut(right.select(on, F.col(copies).alias("_copies"), F.struct(*values).alias("_value")), "lookup")
    total = stored.agg(F.sum("_copies")).first()[0] or 0
    salts = F.greatest(F.lit(1), F.ceil(F.col("_copies") * (parts * SHARES) / F.lit(max(total, 1)))).cast("int")
    sized = stored.withColumn("_salts", salts)
    hot = sized.filter("_salts > 1").select(on, "_salts")
    repeated = sized.select(on, "_value", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    spread = F.when(F.col(on).isNull(), F.lit(parts * SHARES)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), spread).cast("int"))
    joined = salted.join(repeated, [on, "_salt"], "left")
    return joined.select(*left.columns, *[F.col(f"_value.{v}").alias(v) for v in values])


def join_spread(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: str) -> DataFrame:
    """Inner join on columns that neither side is unique on, with the left rows of hot keys spread.

    The left rows of each key are counted first, which reads that side once more. A key with more rows than a
    share of a mean shuffle partition is hot: its right rows are repeated under as many salts as it fills
    such shares. Only hot keys and their salts are broadcast, fewer rows than there are shares.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(left.groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    salts = F.ceil(F.col("_n") * (parts * SHARES) / F.lit(max(total, 1))).cast("int")
    hot = counts.select(*on, salts.alias("_salts")).filter("_salts > 1")
    number = F.coalesce("_salts", F.lit(1))
    salted = left.join(F.broadcast(hot), [*on], "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), number).cast("int")).drop("_salts")
    repeated = right.join(F.broadcast(hot), [*on], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), number - 1))).drop("_salts")
    # The sides may be small and the pairs very many: the number of partitions is given, so that it is not made smaller.
    left, right = (side.repartition(parts, *on, "_salt") for side in (salted, repeated))
    # A merge: by the size of its files Spark might broadcast a side that is many times larger in memory.
    return left.join(right.hint("merge"), [*on, "_salt"]).drop("_salt")


def fits(stored: DataFrame, columns: Sequence[str], limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether some columns of a stored table are small enough to be broadcast; reads it once."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64))
    return (stored.agg(F.sum(size)).first()[0] or 0) <= limit


def keep_listed(
    big: DataFrame, keys: DataFrame, key: str, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys``, a stored table whose size is taken first.

    A short list is broadcast, so that ``big`` is filtered where it is read; a long one goes
    through a shuffle join.
    """
    wanted = keys.filter(F.col(key).isNotNull()).select(key).distinct()
    short = fits(keys, [key], max_bytes)
    return big.join(F.broadcast(wanted) if short else wanted, key, "left_semi")
