import random
from itertools import combinations

import pytest
import xxhash
from conftest import EDGES
from pyspark.sql import functions as F

from sieverank.llm import simhash


def fingerprint(text):
    words = [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> smallest reachable, by comparing all pairs."""
    least = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in combinations(prints, 2):
            if (x ^ y).bit_count() <= 2 and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def some_texts(seed):
    rng = random.Random(seed)
    base = [[rng.choice("the of and Ünter thing ea Or".split()) for _ in range(rng.choice([1, 2, 3, 5, 40, 200]))] for _ in range(12)]
    rows = []
    for number in range(70):
        words = list(rng.choice(base))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(["x", "Y"])
        rows.append((number * 7 % 71, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


def test_equals_comparing_all_pairs(documents_of):
    rows = some_texts(1) + [(900, None), (800, ""), (850, " \t")]
    found = {r.doc_id: r for r in simhash.near_duplicates(documents_of(rows)).collect()}
    prints = [(d, fingerprint(t)) for d, t in rows]
    assert {d: f"{p:016x}" for d, p in prints} == {d: r.fingerprint for d, r in found.items()}
    assert components(prints) == {d: r.component_id for d, r in found.items()}
    assert found[900].component_id == 800


def test_links_follow_chains_of_bits(spark):
    chain = [0, 0b11, 0b1111, 1 << 63 | 0b1111, 0xFF00FF00FF]
    signed = [c - (1 << 64) if c >> 63 else c for c in chain]
    found = simhash.links(spark.createDataFrame([(c,) for c in signed], "print long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    assert {x for r in found for x in (r.a, r.b)} == set(signed[:4])
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "print long"), 3)


def test_edges_and_one_per_group(documents_of):
    frame = documents_of(EDGES)
    found = simhash.near_duplicates(frame).collect()
    assert len(found) == len(EDGES)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert simhash.near_duplicates(frame.filter(F.lit(False))).count() == 0


def test_texts_that_share_an_id(documents_of):
    x, near, y, z = "one two three four five six", "one two three four five six", "other words that nobody else has", "a third text of its own here"
    rows = [(3, x), (5, near), (5, y), (9, z), (9, z), (9, "and yet another text"), (None, x), (None, y), (7, y)]
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(documents_of(rows)).collect()), key=str)
    want = [(3, 3), (5, 3), (5, 5), (9, 9), (9, 9), (9, 9), (None, 3), (None, 5), (7, 5)]
    assert found == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(documents_of(rows)).collect()), key=str)
    assert kept == sorted([(3, x), (5, y), (9, z), (9, "and yet another text"), (None, x), (None, y)], key=str)


def test_an_id_does_not_link_its_texts(documents_of):
    # 8 is linked to 2 by one of its texts only
    rows = [(2, "alpha beta gamma delta"), (8, "alpha beta gamma delta"), (8, "entirely different content of words"), (20, "entirely different content of words")]
    found = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(documents_of(rows)).collect())
    assert found == [(2, 2), (8, 2), (8, 8), (20, 8)]
