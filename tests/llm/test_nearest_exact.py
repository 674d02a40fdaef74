import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieverank.llm import nearest_exact as ne


def brute(rows, every=50, k=5):
    kept = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    asking = {}
    for i, v in sorted(kept, key=lambda r: (r[0], len(r[1]), r[1])):
        if i % every == 0:
            asking.setdefault(i, v)
    found = []
    for q, v in asking.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in kept if i != q and len(w) == len(v))
        found += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


def some_vectors(seed, count=400, width=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.7]) for _ in range(width)]) for i in range(count)]
    rows += [(i, rows[7][1]) for i in range(1_000, 1_100)]  # many copies, so many ties
    rows += [(50, rows[3][1]), (None, rows[4][1]), (2_000, None), (2_050, []), (2_100, [1.0, None, 0.0, 0.0]), (2_150, [math.nan] * width)]
    return rows + [(2_200, [math.inf] * width), (2_250, [1.0, 2.0]), (2_251, [0.5, -1.0]), (2_300, [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_ROWS", 40), ("SHARDS_PER_CELL", 2), ("BLOCK_QUERIES", 3), ("BLOCKS_PER_CELL", 2), ("LEAF_ROWS", 4)):
            monkeypatch.setattr(ne, name, value)
    rows = some_vectors(1)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"width": F.lit(0), "shard": F.lit("x")})
    found = ne.top_k(frame)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == brute(rows)
    assert ne.top_k(frame.filter(F.lit(False))).count() == 0


def test_cells_meet_across_many_partitions(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("SHARDS_PER_CELL", 2), ("BLOCK_QUERIES", 3), ("BLOCKS_PER_CELL", 2), ("LEAF_ROWS", 4)):
        monkeypatch.setattr(ne, name, value)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    before = {name: spark.conf.get(name) for name in settings}
    rows = some_vectors(2)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = ne.top_k(frame).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute(rows)


def test_leaves_hold_all_rows_and_pruning_is_exact():
    rng = np.random.default_rng(4)
    points = rng.integers(-9, 9, (300, 3))
    found = ne.leaves(points, np.arange(300), 10)
    assert sorted(np.concatenate(found).tolist()) == list(range(300)) and max(map(len, found)) <= 10
    big = np.array([[1 << 40, 3]])
    assert ne.exact_dtype(big, big) is object and ne.exact_dtype(points, points) is np.float64
