"""Nearest records by the terms they share with a query, without the blocks that hold none of the nearest.

Postings are a table with one row per term and block of records: the records that hold the term there, with their
weights, and the largest of these. A some ``MOST_POSTINGS`` postings at most; so a term that occurs everywhere is spread over all blocks, and records
with many terms, whose weights are small, lie in blocks with low bounds.

What a query's terms can add up to in a block bounds all scores there. Each query is first ranked in the block
where its bound is highest; then in all other blocks whose bound reaches the k-th score found there. A
task ranks a group of queries in a block and hands on k rows a query. Results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from sieverank.operators.joins import keep_listed
from sieverank.session import cut

#: Blocks and groups of queries grow with the tables up to the second size, as many as the first number of them:
#: a group takes a copy of the postings it asks for, so their number must not follow the number of queries.
BLOCKS, BLOCK_POSTINGS, MOST_POSTINGS = 16, 1 << 20, 1 << 22
GROUPS, GROUP_QUERIES, MOST_QUERIES = 4, 2_048, 1 << 15
#: Distances are compared with 9 decimals: scores this close to the k-th may share its rank.
SLACK = 2e-9


def postings_of(records: DataFrame, asked: DataFrame, key: str, block_postings: int = BLOCK_POSTINGS) -> tuple[DataFrame, DataFrame]:
    """``(term, block, keys, weights, high)`` of the terms in ``asked``, and all records as ``(block, keys, sigs)``, with ``sig`` if they have it."""
    length = F.floor(F.log2(F.size("terms") + F.lit(1))).cast("int")
    usable = records.filter(F.col("terms").isNotNull()).withColumn("_length", length)
    counts = usable.groupBy("_length").agg(F.sum(F.size("terms")).alias("n")).collect()  # a row per doubling of the length
    pieces, start = F.lit(1), F.lit(0)
    first = 0
    total = sum(row["n"] for row in counts)
    block_postings = max(block_postings, min(MOST_POSTINGS, -(-total // BLOCKS))) if block_postings == BLOCK_POSTINGS else block_postings
    for row in sorted(counts, key=lambda r: r["_length"]):
        here, number = F.col("_length") == row["_length"], max(1, -(-row["n"] // block_postings))
        pieces, start = F.when(here, number).otherwise(pieces), F.when(here, first).otherwise(start)
        first += number
    placed = usable.withColumn("block", (start + F.pmod(F.xxhash64(key), pieces)).cast("int"))
    entries = placed.select("block", F.col(key).alias("key"), F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    entries = keep_listed(entries.select("block", "key", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight")), asked, "term")
    found = entries.groupBy("term", "block").agg(F.collect_list(F.struct("key", "weight")).alias("p"), F.max("weight").alias("high"))
    sig = F.col("sig") if "sig" in records.columns else F.lit(None).cast("array<long>")
    members = placed.groupBy("block").agg(F.collect_list(F.struct(F.col(key).alias("key"), sig.alias("sig"))).alias("m"))
    return (
        found.select("term", "block", F.col("p.key").alias("keys"), F.col("p.weight").alias("weights"), "high"),
        members.select("block", F.col("m.key").alias("keys"), F.col("m.sig").alias("sigs")),
    )


def sparse_topk(
    records: DataFrame, queries: DataFrame, k: int, key: str, zeros: DataFrame | None = None,
    block_postings: int = BLOCK_POSTINGS, group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """``(query_id, key, distance)``: candidates that hold the k nearest records of every query, with exact distances.

    Features are ``terms`` and ``weights``, above zero, on both sides; a distance is 1 minus the sum of products.
    Records with null terms are left out. A record that shares no term is at distance 1: ``zeros`` has the first k
    of all by key, as ``(query_id, key)``; without conditions they are taken from the records. With ``sig`` on the
    records and ``mask`` on the queries only records that hold all bits of a query's mask count.
    """
    masked = "mask" in queries.columns and "sig" in records.columns
    asking = queries.filter(F.col("terms").isNotNull())
    if zeros is None:
        if masked:
            raise ValueError("with conditions the first records of each query have to be given")
        first = records.filter(F.col("terms").isNotNull()).select(F.col(key).alias("key")).orderBy("key").limit(k).collect()  # k rows
        listed = F.array(*[F.lit(r["key"]) for r in first]).cast(ArrayType(records.schema[key].dataType))
        zeros = asking.select("query_id", F.explode(listed).alias("key"))
    pairs = asking.select("query_id", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    asked = cut(pairs.select("query_id", F.col("e.terms").alias("term"), F.col("e.weights").alias("asked")), "asked-terms")
    carried = records.select(key, "terms", "weights", *(["sig"] if masked else []))
    postings, members = postings_of(carried, asked, key, block_postings)
    postings, members = cut(postings, "postings"), cut(members, "members") if masked else None

    most = F.sum(F.col("asked") * F.col("high")).alias("most")
    reach = asked.join(postings.select("term", "block", "high"), "term").groupBy("query_id", "block").agg(
        most, F.collect_list(F.struct("term", "asked")).alias("asked")
    )
    n_queries = queries.count()
    group_queries = max(group_queries, min(MOST_QUERIES, -(-n_queries // GROUPS))) if group_queries == GROUP_QUERIES else group_queries
    groups = max(1, -(-n_queries // group_queries))
    reach = reach.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    if masked:
        reach = reach.join(asking.select("query_id", "mask"), "query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    reach = cut(reach.withColumn("place", F.row_number().over(best)), "reach")

    kind, key_kind = queries.schema["query_id"].dataType, records.schema[key].dataType
    near = cut(_ranked(reach.filter("place = 1"), postings, members, k, kind, key_kind), "nearest-first")
    kth = near.groupBy("query_id").agg((1.0 - F.max("distance") - SLACK).alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
    others = reach.filter("place > 1").join(kth.select("query_id", "kth"), "query_id", "left")
    rest = _ranked(others.filter(F.col("most") >= F.coalesce("kth", F.lit(0.0))), postings, members, k, kind, key_kind)
    none = zeros.select("query_id", F.col(zeros.columns[1]).alias("key"), F.lit(1.0).alias("distance"))
    return near.unionByName(rest).unionByName(none).groupBy("query_id", "key").agg(F.min("distance").alias("distance"))


def _ranked(asked: DataFrame, postings: DataFrame, members: DataFrame | None, k: int, kind, key_kind) -> DataFrame:
    """The k nearest records of each query in each block it asks for."""
    cells = asked.select("block", "group").distinct()
    wanted = asked.select("block", "group", F.explode("asked.term").alias("term")).distinct()
    left = postings.join(wanted, ["block", "term"]).select("block", "group", "term", "keys", "weights", F.lit(None).cast("array<array<long>>").alias("sigs"))
    if members is not None:
        none = F.lit(None)
        left = left.unionByName(members.join(cells, "block").select("block", "group", none.cast("string").alias("term"), "keys", none.cast("array<double>").alias("weights"), "sigs"))
    carried = ["mask"] if members is not None else []
    right = asked.select(F.col("block").alias("of_block"), F.col("group").alias("of_group"), "query_id", F.col("asked.term").alias("terms"), F.col("asked.asked").alias("asked"), *carried)
    schema = pa.schema([("query_id", to_arrow_type(kind)), ("key", to_arrow_type(key_kind)), ("distance", pa.float64())])

    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        return _rank_block(postings, queries, k, schema)

    return left.groupBy("block", "group").cogroup(right.groupBy("of_block", "of_group")).applyInArrow(
        run, f"query_id {kind.simpleString()}, key {key_kind.simpleString()}, distance double"
    )


def _rank_block(postings: pa.Table, queries: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    if not postings.num_rows or not queries.num_rows:
        return schema.empty_table()
    keys = postings.column("keys").combine_chunks()
    coded = keys.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # numbers in the order of keys
    record = rank[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(keys).to_numpy(zero_copy_only=False))])
    weights = postings.column("weights").combine_chunks()
    weight, starts = weights.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(weights), 0).to_numpy(zero_copy_only=False))])
    terms = postings.column("term").to_pylist()
    of = {t: (record[ends[i] : ends[i + 1]], weight[starts[i] : starts[i + 1]]) for i, t in enumerate(terms) if t is not None}
    masks = queries.column("mask").to_pylist() if "mask" in queries.column_names else None
    words = None
    if masks is not None:
        i = terms.index(None)
        flat = postings.column("sigs").combine_chunks()[i].values.flatten().to_numpy(zero_copy_only=False)
        words = np.empty((len(order), len(flat) // (ends[i + 1] - ends[i])), np.int64)
        words[record[ends[i] : ends[i + 1]]] = flat.reshape(ends[i + 1] - ends[i], -1)
    allowed: dict[tuple, np.ndarray] = {}
    found, score = [], np.zeros(len(order))
    asked = zip(queries.column("terms").to_pylist(), queries.column("asked").to_pylist(), strict=True)
    for number, (names, factors) in enumerate(asked):
        for name, factor in zip(names, factors, strict=True):
            at, values = of[name]
            score[at] += factor * values
        touched = np.flatnonzero(score)
        distance = 1.0 - score[touched]
        score[touched] = 0.0
        if masks is not None:
            mask = tuple(masks[number])
            if mask not in allowed:
                allowed[mask] = ((words & mask) == mask).all(axis=1)
            kept = allowed[mask][touched]
            touched, distance = touched[kept], distance[kept]
        rounded = np.round(distance, 9)
        if len(touched) > k:
            near = np.flatnonzero(rounded <= np.partition(rounded, k - 1)[k - 1])
            near = near[np.lexsort((touched[near], rounded[near]))][:k]
            touched, distance = touched[near], distance[near]
        found.append((np.full(len(touched), number), order[touched], distance))
    number, record, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    columns = [queries.column("query_id").combine_chunks().take(pa.array(number)), coded.dictionary.take(pa.array(record)), pa.array(distance, pa.float64())]
    return pa.Table.from_arrays(columns, schema=schema)
