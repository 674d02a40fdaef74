"""Hot keys, hot buckets, missing keys, and vectors from a model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieverank.operators import ann, joins, nearest
from sieverank.operators.lexical import embed


def test_hot_and_missing_keys_are_joined_like_any_other(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(9000)]
    left = spark.createDataFrame(rows, "id long, k string")
    counts = left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    right = counts.filter("k <> 'k8'").withColumn("v", F.upper("k"))
    got = joins.join_hot(left, right, on="k", copies="n", spread_by="id").collect()
    assert len(got) == 9000
    for r in got:
        expected = None if r["k"] in (None, "k8") else r["k"].upper()
        assert r["v"] == expected
    assert sum(r["n"] == 3000 for r in got) == 3000


def test_hot_rows_are_spread(spark):
    left = spark.range(4000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 4000, 1)], "k string, n long, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.join_hot(left, right, on="k", copies="n", spread_by="id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 1600


@pytest.mark.parametrize("max_bytes", [0, 1000])
def test_keep_listed(spark, max_bytes):
    big = spark.range(100).withColumnRenamed("id", "k")
    keys = spark.createDataFrame([(3,), (3,), (None,), (500,)], "k long")
    assert [r["k"] for r in joins.keep_listed(big, keys, "k", max_bytes).collect()] == [3]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 900)] + 0.05 * rng.normal(size=(900, 16))
    vectors[300:600] = vectors[300]  # a third of the rows are copies of one
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows + [(900, None), (901, [1.0])], "key long, vector array<double>").repartition(4)


def rounded(df):
    return {(r["query_id"], r["rank"], r["key"], round(r["distance"], 9)) for r in df.collect()}


def test_approximate_neighbours(spark, clustered):
    queries = clustered.filter("key % 10 = 0 AND size(vector) = 16").withColumnRenamed("key", "query_id")
    exact = nearest.block_topk(clustered, queries, 3, "key")
    found = ann.ann_topk(clustered, queries, 3, "key", dim=16, tables=6, bits=5)
    assert ann.recall(found, exact, "key").first()["recall"] > 0.95
    # dividing full buckets changes nothing
    small = ann.ann_topk(clustered, queries, 3, "key", dim=16, tables=6, bits=5, fragment_rows=20, block_queries=4)
    assert rounded(small) == rounded(found)
    # among its candidates a query gets exact distances: all found pairs are in exact order
    pairs = found.join(exact, ["query_id", "key"]).select(F.max(F.abs(found["distance"] - exact["distance"])))
    assert pairs.first()[0] < 1e-12


def test_any_number_of_cells(clustered):
    queries = clustered.filter("key = 10").withColumnRenamed("key", "query_id")
    found = ann.ann_topk(clustered, queries, 1, "key", 16, tables=8, bits=20).collect()
    assert [(r["key"], round(r["distance"], 9)) for r in found] == [(10, 0.0)]



def test_embedding_with_a_model(spark):
    def load():
        return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]

    df = spark.createDataFrame([("banana",), ("kiwi",), (None,)], "t string")
    got = [list(r["vector"]) for r in embed(df, "t", load).collect()]
    assert sorted(got) == [[0.0, 0.0], [4.0, 0.0], [6.0, 3.0]]
