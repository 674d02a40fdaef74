"""Each stage's result against brute force, on the smallest tables."""

import os
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGES
from test_lines import brute
from test_simhash import fingerprint

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from sieverank.llm import decontamination as dc  # noqa: E402
from sieverank.llm import lines  # noqa: E402
from sieverank.session import cut  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(cut(stage(spark, found[-1], SF_DIR), "stage"))
    return found


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns_stay(stages):
    assert all(f.columns == stages[0].columns for f in stages[:5])
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_junk_goes(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after) <= set(before) and all(after[d] == before[d] for d in after)
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in good) >= 0.97 * len(good) and sum(d in after for d in bad) <= 0.1 * len(bad)


def test_lines_go(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = {}
    for doc, line, *_ in brute(list(before.items()), close=lines.within_one):
        gone.setdefault(doc, set()).add(line)
    for doc, text in before.items():
        rest = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone.get(doc, ()))
        if doc in gone and not rest.split():
            assert doc not in after
        else:
            assert after[doc] == (rest if doc in gone else text)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    prints = {d: fingerprint(t) for d, t in before.items()}
    least = {d: d for d in before}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert set(after) == set(least.values())


def test_benchmark_passages_go(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    items = dc.Items(rows, dc.SIMILARITY, 1, 1)
    number = {w: i + 1 for i, w in enumerate(items.vocabulary.to_pylist())}
    for doc, text in before.items():
        words = dc.plain_words(pa.array([text], pa.string()))[0].to_pylist()
        coded = np.array([number.get(w, 0) for w in words], np.int32)
        leaked = any(dc.passage_distance(w, coded)[0] <= e for w, e in zip(items.words, items.edits, strict=True))
        assert (doc in after) != leaked


def test_all_tokens_are_packed(spark, stages):
    packed = {}
    for r in stages[5].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == {d: len(t.split()) for d, t in texts(stages[4]).items() if t and t.split()}
    assert corpus_pipeline.run(spark, SF_DIR).count() == stages[5].count()


def run_on(spark, docs):
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(cut(stage(spark, found[-1], SF_DIR), "edge-stage"))
    return found


def test_edge_rows_pass_all_stages(spark, documents_of):
    prose = "The old bridge was built by the town in the spring of that year, and the people came to see it. "
    rows = [*EDGES, *[(100 + i, prose * (1 + i % 3) + f"Number {i} was the last of them to leave the house.") for i in range(30)]]
    rows += [(100, rows[-1][1]), (200, "a text of its own that has the id of another text"), (200, prose + "It stands to this day.")]
    docs = documents_of(rows)
    found = run_on(spark, docs)
    assert all(f.columns == docs.columns for f in found[:5])
    first, last = found[1], found[4]
    assert {r.doc_id for r in last.collect()} <= {r.doc_id for r in first.collect()}
    by_id = {}
    for r in found[2].collect():
        by_id.setdefault(r.doc_id, set()).add(r.text)
    assert by_id.get(200, set()) == {r.text for r in first.collect() if r.doc_id == 200}
    assert {r.doc_id for r in found[5].collect()} == {r.doc_id for r in last.collect() if r.text and r.text.split()}


def test_an_empty_table_passes_all_stages(spark, documents_of):
    assert [f.count() for f in run_on(spark, documents_of(EDGES).filter("false"))] == [0] * 6
