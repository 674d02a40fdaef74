import random

import pyarrow as pa
from conftest import EDGES
from pyspark.sql import functions as F

from sieverank.llm import texts, toxicity

SYLLABLES = "an be co da el fi go hu in ja".split()


def corpus(seed=8, count=700):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(3, 7)):
                # half of the expressions are never seen twice: only their letters tell
                words.insert(rng.randrange(len(words)), rng.choice(["Vrk", "vrkz" + "".join(rng.choice(SYLLABLES) for _ in range(3))]))
        rows.append((i + 100, " ".join(words)))
        labels.append((i + 100, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents_of):
    rows, labels = corpus()
    frame = spark.createDataFrame(labels, "doc_id long, toxic int").withColumns({"text": F.lit("x"), "label": F.lit(0)})
    found = toxicity.score(documents_of([*rows, *((-1 if i is None else i, t) for i, t in EDGES)]), frame).collect()
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert 150 < len(held) < 320
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert len(found) == len(rows) + len(EDGES)


def test_a_fixed_expression_tells_by_its_pair(spark):
    """The second word follows one word only, so it has no continuation mass; its letters are everyday ones."""
    rng = random.Random(4)
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(200):
        words = [rng.choice(made) for _ in range(20)]
        words[10:11] = ["becoda", "gohujaan"] if i % 2 else ["becoda"]
        rows.append((i % 2, 0, " ".join(words)))
    texts.prepare(spark)
    sample = spark.createDataFrame(rows, "label long, fold long, text string")
    models = toxicity.build(toxicity.pair_counts(sample), toxicity.word_types(sample))
    words, starts = texts.split_words(pa.array(["becoda gohujaan", "becoda", "gohujaan"]))
    both, first, second = models.differences(words, starts)[0]
    assert both > max(first, first + second) + 1


def test_one_class_no_label_and_empty(spark, documents_of):
    frame = documents_of(EDGES)
    clean = spark.createDataFrame([(3, 0), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(frame, clean).collect()} == {0}
    none = clean.filter(F.lit(False))
    assert {r.predicted for r in toxicity.score(frame, none).collect()} == {0}
    assert toxicity.score(frame.filter(F.lit(False)), clean).count() == 0
