import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieverank.llm import orchard

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Codes by comparing every part with every entry, in Python's numbers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in kept]
    usable = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    widths = sorted({len(r[1]) for r in usable}, key=lambda w: (-sum(len(r[1]) == w for r in usable), w))
    usable = sorted((r for r in usable if len(r[1]) == widths[0]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = widths[0] // parts
    books = [[r[1][p * w : p * w + w] for r in usable[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            near = {}
            for _, v, _ in usable:
                x = v[p * w : p * w + w]
                near.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*near[e])] if e in near else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for i, v, lab in kept:
        if len(v) != widths[0]:
            coded.append((i, None, None, lab))
            continue
        best = [nearest(v[p * w : p * w + w], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab))
    sums = {}
    for _, _, e, lab in coded:
        if e is not None:
            sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, c, e, sums.get(lab), digest) for i, c, e, lab in coded), key=str)


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("vector", "width", "code", "error", "part", "n", "copies")})
    return sorted((tuple(r) for r in orchard.compress(frame, **more).collect()), key=str)


def test_search_equals_comparing_all():
    rng = np.random.default_rng(1)
    for k, high in ((1, 9), (2, 3), (16, 4), (16, 1000), (40, 6)):
        books = orchard.Books.of(rng.integers(-high, high, (3, k, 4)))
        x = rng.integers(-high, high, (200, 12))
        codes, distance = books.nearest(x)
        every = ((x.reshape(200, 3, 1, 4) - books.entries[None]) ** 2).sum(axis=3)
        assert (codes == every.argmin(axis=2)).all() and (distance == every.min(axis=2)).all()


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(size=16) / 9], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(120)]
    rows += [(3, [0.0] * 16, 1), (3, [-0.0] * 16, 1), (None, [0.25] * 16, 2), (7, rows[0][1], 0), (8, rows[0][1], 0)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 14, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, 1)]
    rows += [(204, [1.0] * 24, 1), (205, [], 9), (206, [1.0] * 5, 1)]
    assert found(spark, rows) == brute(rows)


def test_few_rows_and_ties(spark):
    rows = [(2, [0.5] * 8, None), (1, [0.5] * 8, 4), (9, [0.25] * 8, None), (4, [0.75] * 8, 4)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, rounds=0) == brute(rows, rounds=0)


def test_a_hot_label(spark):
    rows = [(i, [i / 7] * 8, 1 if i % 3 else None) for i in range(400)]
    assert found(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    assert [r[:4] for r in found(spark, [(1, [1.0], 1)])] == [(1, None, None, None)]


def test_too_large_is_refused(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e300] * 8, 1)])
