from itertools import combinations

import numpy as np
from conftest import EDGES
from pyspark.sql import functions as F

from sieverank.llm import packing


def padding(counts, bounds):
    lengths = np.flatnonzero(counts)
    return sum(int(counts[n]) * (min(b for b in bounds if b >= n) - n) for n in lengths)


def test_boundaries_lose_least():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = rng.integers(0, 4, rng.integers(2, 11))
        lengths = np.flatnonzero(counts)
        if not len(lengths):
            continue
        for buckets in (1, 2, 3):
            found = packing.boundaries(counts, buckets)
            assert len(found) <= buckets and found[-1] == lengths[-1]
            every = [(*c, lengths[-1]) for k in range(buckets) for c in combinations(lengths[:-1], k)]
            assert padding(counts, found) == min(padding(counts, b) for b in every)


def test_every_token_is_packed_once(documents_of):
    frame = documents_of([*EDGES, *[(100 + i, "w " * (1 + i * 7 % 40)) for i in range(200)]])
    found = [r.asDict() for r in packing.pack(frame, max_tokens=32, buckets=3, batch_tokens=256).collect()]
    sizes = {}
    for r in found:
        sizes.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
    want = {i: len(t.split()) for i, t in frame.select("doc_id", F.coalesce("text", F.lit(""))).collect() if t.split() and i != 4}
    assert {i: sum(n for _, n in parts) for i, parts in sizes.items() if i != 4} == want
    assert sizes[4] == [(0, 1), (0, 1)]
    for parts in sizes.values():
        assert all(0 < n <= 32 for _, n in parts)
    places = {}
    for r in found:
        assert r["n_tokens"] <= r["bucket"]
        places.setdefault(r["bucket"], set()).add((r["batch"], r["row"]))
    for bucket, seen in places.items():
        room = max(1, 256 // bucket)
        assert sorted(seen) == [(i // room, i % room) for i in range(len(seen))]
    assert len(found) == sum(map(len, places.values())) and len(places) <= 3


def test_slices_number_on(documents_of, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 10)
    found = packing.pack(documents_of([(i % 50, "a b c") for i in range(300)]), batch_tokens=12).collect()
    assert sorted((r.batch, r.row) for r in found) == [(i // 4, i % 4) for i in range(300)]


def test_empty_table(documents_of):
    assert packing.pack(documents_of(EDGES).filter(F.lit(False))).count() == 0
    assert packing.pack(documents_of([(1, None), (2, " ")])).count() == 0
