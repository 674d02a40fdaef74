import numpy as np
import pytest
from conftest import EDGES
from pyspark.sql import functions as F

from sieverank.llm import decontamination as dc


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_passage_distance_is_that_of_the_best_part():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = rng.integers(1, 4, rng.integers(1, 6)), rng.integers(1, 4, rng.integers(0, 8))
        parts = [edits(item.tolist(), text[a:b].tolist()) for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
        cost, start, end = dc.passage_distance(item, text)
        assert cost == min(parts) == edits(item.tolist(), text[start:end].tolist())


def changed(rng, words, count, vocabulary):
    words = list(words)
    for _ in range(count):
        at, kind = rng.integers(len(words)), rng.integers(3)
        if kind == 0:
            words[at] = int(rng.integers(1, vocabulary))
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, int(rng.integers(1, vocabulary)))
    return words


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_recall_against_brute_force(share):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(rng.choice(vocabulary, rng.integers(3, 60)))) for n in range(120)]
    items = dc.Items(rows, dc.SIMILARITY, dc.TABLES, dc.SAMPLES)
    found = 0
    for n in range(len(rows)):
        part = changed(rng, items.words[n], int(items.edits[n] * share), items.top)
        text = np.concatenate([rng.integers(0, items.top, 30), part, rng.integers(0, items.top, 30)]).astype(np.int32)
        assert dc.passage_distance(items.words[n], text)[0] <= items.edits[n]
        found += n in {item for _, item, *_ in dc.leaks(text, np.array([0, len(text)]), items)}
    assert found >= 0.9 * len(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 26, 40])
def test_recall_by_length_of_the_item(size):
    rng = np.random.default_rng(size)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = [(n, " ".join(rng.choice(vocabulary, size))) for n in range(150)]
    items = dc.Items(rows, dc.SIMILARITY, dc.TABLES, dc.SAMPLES)
    for share in (0.0, 1.0):
        found = 0
        for n in range(len(rows)):
            part = changed(rng, items.words[n], int(items.edits[n] * share), items.top)
            text = np.concatenate([rng.integers(0, items.top, 30), part, rng.integers(0, items.top, 30)]).astype(np.int32)
            found += n in {item for _, item, *_ in dc.leaks(text, np.array([0, len(text)]), items)}
        assert found >= (1.0 if size <= dc.WHOLE else 0.95) * len(rows)


def test_items_in_no_table_of_walks_are_found():
    words = [f"w{i}" for i in range(40)]
    items = dc.Items([(1, " ".join(words))], dc.SIMILARITY, 0, dc.SAMPLES)
    for gone in ([], [0], [5, 6], [0, 11], [4, 8], [2, 7, 12, 17, 22, 27, 32, 37]):
        text = np.append(np.delete(items.words[0], gone), 0).astype(np.int32)
        assert [item for _, item, *_ in dc.leaks(text, np.array([0, len(text)]), items)] == [0]


@pytest.mark.parametrize("size", [10, 20, 30, 60])
def test_a_text_that_lacks_the_items_ends_is_found_between_others(size):
    words = [f"w{i}" for i in range(size)]
    items = dc.Items([(1, " ".join(words))], dc.SIMILARITY, dc.TABLES, dc.SAMPLES)
    other = np.zeros(30, np.int32)
    text = np.concatenate([other, items.words[0][1:-1], other])
    found = list(dc.leaks(text, np.array([0, 30, 30 + size - 2, len(text)]), items))
    assert found == [(1, 0, 2, 0, size - 2)]


def test_finds_equal_and_near_passages_and_keeps_clean(spark, documents_of):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch it from above"
    near = item.replace("lazy", "very lazy").replace("seven", "eight").upper()
    docs = [*EDGES, (30, f"before, {item}. after"), (31, f"x {near} y"), (32, "the quick brown fox is not here over a lazy dog"), (33, "a" + item)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two"), (None, "word")], "item_id long, text string")
    frame = documents_of(docs)
    found = {(r.doc_id, r.item_id): r for r in dc.find(frame, bench.withColumn("doc_id", F.lit(0))).collect()}
    assert set(found) == {(30, 1), (31, 1), (33, 1)}
    assert (found[30, 1].edits, found[30, 1].first_word, found[30, 1].end_word) == (0, 1, 17)
    assert found[31, 1].edits == 2 and found[33, 1].edits == 1
    kept = dc.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 6, 32}
    assert dc.find(frame.filter(F.lit(False)), bench).count() == 0
    assert dc.find(frame, bench.filter(F.lit(False))).count() == 0
