import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieverank.functions.measures import cosine_distance, cosine_distance_to
from sieverank.operators import lexical, nearest
from sieverank.operators.blocks import QueryBlock
from sieverank.operators.lexical import build_index, query_vectors, term_weights


def brute(records, queries, k, allowed=lambda q, r: True):
    """(query, rank, key, distance) by the definition."""

    def unit(v):
        v = np.asarray(v, dtype=float)
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    out = set()
    for q, qv in queries.items():
        scored = sorted(
            (round(1 - float(unit(v) @ unit(qv)), 9), r)
            for r, v in records.items()
            if v is not None and len(v) == len(qv) and allowed(q, r)
        )
        out |= {(q, i + 1, r, round(d, 4)) for i, (d, r) in enumerate(scored[:k])}
    return out


def rows(df):
    return {
        (r["query_id"], r["rank"], r["key"], round(r["distance"], 4) + 0.0) for r in df.collect()
    }


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    records = {i: rng.normal(size=6).tolist() for i in range(300)}
    copy = records[0]
    for i in range(100, 220):  # a third of the records are copies of one
        records[i] = list(copy)
    records[250] = [0.0] * 6
    records[251] = None
    records[252] = [1.0, 2.0]
    queries = {f"q{i}": rng.normal(size=6).tolist() for i in range(12)}
    queries["copy"] = list(copy)
    queries["zero"] = [0.0] * 6
    return records, queries


def frames(spark, records, queries, name="key"):
    left = spark.createDataFrame(list(records.items()), f"{name} long, vector array<double>").repartition(5)
    right = spark.createDataFrame(list(queries.items()), "query_id string, vector array<double>")
    return left, right


@pytest.mark.parametrize("k", [1, 3, 400])
def test_queries_near_the_records(spark, data, k):
    left, right = frames(spark, *data)
    assert rows(nearest.block_topk(left, right, k, "key")) == brute(*data, k)


@pytest.mark.parametrize("sizes", [{}, {"fragment_rows": 40, "block_queries": 3}])
def test_grid_gives_the_same(spark, data, sizes):
    left, right = frames(spark, *data)
    got = nearest.block_topk(left, right, 3, "key", max_broadcast_bytes=0, **sizes)
    assert rows(got) == brute(*data, 3)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_masks_restrict_the_records(spark, data, limit):
    records, queries = data
    left, right = frames(spark, records, queries)
    left = left.withColumn(
        "sig", F.array((F.col("key") % 4).cast("long"), F.when(F.col("key") > 200, 1 << 61).otherwise(0))
    )
    masks = {q: (i % 3, (i % 2) << 61) for i, q in enumerate(queries)}
    masks["q3"] = (64, 0)  # no record has this bit
    table = spark.createDataFrame([(q, list(m)) for q, m in masks.items()], "query_id string, mask array<long>")

    def allowed(q, r):
        sig = (r % 4, 1 << 61 if r > 200 else 0)
        return all(s & m == m for s, m in zip(sig, masks[q]))

    got = nearest.block_topk(left, right.join(table, "query_id"), 3, "key", max_broadcast_bytes=limit)
    assert rows(got) == brute(records, queries, 3, allowed)
    assert not any(r[0] == "q3" for r in rows(got))


def test_string_keys_and_no_queries(spark, data):
    records, queries = data
    left, right = frames(spark, records, queries)
    left = left.select(F.format_string("k%04d", "key").alias("name"), "vector")
    got = nearest.block_topk(left, right, 3, "name").withColumnRenamed("name", "key")
    named = {f"k{i:04d}": v for i, v in records.items()}
    assert rows(got) == brute(named, queries, 3)
    assert nearest.block_topk(left, right.filter("false"), 3, "name").count() == 0
    assert nearest.block_topk(left.filter("false"), right, 3, "name").count() == 0


def test_distance_expressions(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0],), ([0.0, 2.0],), ([0.0, 0.0],), ([-3.0, 0.0],), (None,), ([1.0],)],
        "v array<float>",
    )
    expected = [0.0, 1.0, 1.0, 2.0, None, None]
    single = df.select(cosine_distance_to("v", [2.0, 0.0]).alias("d")).collect()
    pair = df.select(cosine_distance(F.col("v"), F.array(F.lit(2.0), F.lit(0.0))).alias("d")).collect()
    assert [r["d"] for r in single] == expected
    assert [r["d"] for r in pair] == expected


TEXTS = {
    1: "red bolt red nut",
    2: "Blue bolt",
    3: "",
    4: "red bolt red nut",
    5: "bolt wrench 10 mm",
    6: None,
}


def lexical_brute(texts, queries):
    import math
    import re
    from collections import Counter

    docs = {k: Counter(re.findall(r"[a-z0-9\-]+", (t or "").lower())) for k, t in texts.items()}
    df = Counter(t for d in docs.values() for t in d)

    def vec(counts):
        w = {t: n * math.log((len(docs) + 1) / (df[t] + 1)) for t, n in counts.items()}
        n = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / n for t, x in w.items() if n}

    vectors = {k: vec(d) for k, d in docs.items()}
    out = set()
    for q, text in queries.items():
        qv = vec(Counter(re.findall(r"[a-z0-9\-]+", text.lower())))
        scored = sorted(
            (round(1 - sum(w * v.get(t, 0) for t, w in qv.items()), 9), k) for k, v in vectors.items()
        )
        out |= {(q, i + 1, k, round(d, 4)) for i, (d, k) in enumerate(scored[:3])}
    return vectors, out


@pytest.mark.parametrize("limit, stored, small", [(0, False, 0), (1 << 20, True, 0), (1 << 20, True, 10_000)])
def test_lexical_ranking(spark, monkeypatch, limit, stored, small):
    monkeypatch.setattr(lexical, "SMALL_VOCABULARY", small)
    queries = {"a": "red nut", "b": "blue unseen", "c": "unseen", "d": "wrench bolt bolt"}
    docs = spark.createDataFrame(list(TEXTS.items()), "key long, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    index = build_index(docs, "key", "text", stored=stored)
    vectors, expected = lexical_brute(TEXTS, queries)
    got = {(r["key"], r["term"], round(r["weight"], 9)) for r in term_weights(index).collect()}
    assert got == {(k, t, round(w, 9)) for k, v in vectors.items() for t, w in v.items()}
    vecs = query_vectors(asked, index, "query_id", "text")
    assert rows(nearest.block_topk(index.vectors, vecs, 3, "key", max_broadcast_bytes=limit)) == expected


def test_only_rare_terms_are_looked_up(spark, monkeypatch):
    texts = {i: " ".join(["all", *(["half"] if i % 2 else []), *(["some"] * 2 if i % 4 == 0 else []), f"own{i}"]) for i in range(16)} | {16: "", 17: None}
    docs = spark.createDataFrame(list(texts.items()), "key long, text string")
    vectors, _ = lexical_brute({k: t or "" for k, t in texts.items()}, {"q": "all"})
    want = {(k, t, round(w, 9)) for k, v in vectors.items() for t, w in v.items()}
    looked_up = {}
    join = lexical.join_hot
    for limit in (0, 140, 10_000):
        monkeypatch.setattr(lexical, "SMALL_VOCABULARY", limit)
        monkeypatch.setattr(lexical, "join_hot", lambda left, *a, limit=limit, **b: looked_up.update({limit: {r["term"] for r in left.collect()}}) or join(left, *a, **b))
        index = build_index(docs, "key", "text")
        assert {(r["key"], r["term"], round(r["weight"], 9)) for r in term_weights(index).collect()} == want
        assert index.vectors.count() == 18
    assert looked_up[140] == {"some", *(f"own{i}" for i in range(16))} and "all" in looked_up[0] and 10_000 not in looked_up

def test_a_fragment_is_never_unpacked_whole():
    """Beside the Arrow rows a cell takes its queries once in DOUBLE, and of the records a batch at a time."""
    rng, n, width = np.random.default_rng(7), 40_000, 64
    data = rng.standard_normal((n, width)).astype(np.float32)
    data[3] = 0
    vectors = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(data.ravel()))
    keys = rng.permutation(n)
    records = pa.table({"key": keys, "vector": vectors})
    queries = pa.table({"query_id": keys, "vector": vectors})
    tracemalloc.start()
    prepared = QueryBlock(queries, 3)
    unpacked = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    found = pa.Table.from_batches(QueryBlock(queries.slice(0, 8), 3).best(records.to_batches(nearest.BATCH_ROWS)))
    ranked = tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert unpacked < 1.5 * n * width * 8 and ranked < n * width * 8
    assert (prepared.scorer.unit[3] == 0).all()
    unit = data.astype(float) / np.maximum(np.sqrt((data.astype(float) ** 2).sum(axis=1, keepdims=True)), 1e-300)
    distance = np.round(1 - unit[:8] @ unit.T, 9)
    want = sorted((int(keys[q]), int(keys[r])) for q in range(8) for r in np.lexsort((keys, distance[q]))[:3])
    assert sorted(zip(found.column("query_id").to_pylist(), found.column("key").to_pylist())) == want
