import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGES
from pyspark.sql import functions as F

from sieverank.llm import quality

SYLLABLES = "an be co da el fi go hu in ja ka lo mi no".split()


def prose(rng, words):
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if rng.random() < 0.12 else "") for w in made).capitalize() + "."


def junk(rng, kind, words):
    text = prose(rng, words)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split())
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in text.split())
    if kind == 2:
        return " ".join(w for w in text.split()[: words // 10 + 1] for _ in range(12))
    return " | ".join(text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    good = [(i, prose(rng, rng.randint(8, 300))) for i in range(500)]
    return good + [(1_000 + i, junk(rng, i % 4, rng.randint(60, 300))) for i in range(60)]


def test_junk_goes_and_prose_stays(documents_of, corpus):
    frame = documents_of([*corpus, *((i + 5_000 if i else i, t) for i, t in EDGES)])
    found = {r.doc_id: r for r in quality.score(frame, bits=12).collect()}
    wrong = [i for i, _ in corpus if found[i].keep != (i < 1_000)]
    assert len(wrong) <= 3
    assert not found[5_001].keep and not found[5_002].keep and not found[5_003].keep
    kept = quality.keep_good(frame, bits=12)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.keep}


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.9
    rates = [0.9, 0.5, 0.3]
    votes = np.stack([np.where(~truth & (rng.random(len(truth)) < r), 0, 1) for r in rates], axis=1).astype(np.int8)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, chance = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.9) < 0.04 and np.abs(chance[0] - rates).max() < 0.08 and chance[1].max() <= quality.FALSE_ALARM


def test_empty_table_and_features(documents_of):
    assert quality.score(documents_of(EDGES).filter(F.lit(False))).count() == 0
    rows, slots, values = quality.hashed(pa.array(["Ab 12", None, "x"]), 10)
    assert set(rows.tolist()) == {0, 2} and np.allclose(np.bincount(rows, values**2, 3), [1, 0, 1])
