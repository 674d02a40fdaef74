import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGES
from pyspark.sql import functions as F

from sieverank.llm import lines, texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, least=5, close=lambda a, b: distance(a, b) <= 1):
    found = []
    every = sorted((d, i, tuple(line.lower().split())) for d, t in docs if t and d is not None for i, line in enumerate(t.split("\n")))
    every = [x for x in every if len(x[2]) >= least]
    for n, (doc, line, words) in enumerate(every):
        equal = [x for x in every[:n] if x[2] == words]
        near = [x for x in every[:n] if abs(len(x[2]) - len(words)) <= 1 and close(x[2], words)]
        if equal:
            found.append((doc, line, "equal", *equal[0][:2]))
        elif near:
            found.append((doc, line, "near", *near[0][:2]))
    return sorted(found)


def some_documents(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abc") for _ in range(rng.randint(4, 9))] for _ in range(6)]
    docs = []
    for number in range(40):
        texts_ = []
        for _ in range(rng.randint(0, 4)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                change = rng.randint(0, 2)
                if change == 0:
                    words[at] = rng.choice("abcd")
                elif change == 1 and len(words) > 1:
                    del words[at]
                else:
                    words.insert(at, rng.choice("abcd"))
            texts_.append(" ".join(words) if rng.random() < 0.8 else " ".join(words).upper() + " ")
        docs.append((number * 3 % 41, "\n".join(texts_)))
    return docs


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_comparing_all_pairs(documents_of, seed):
    docs = some_documents(seed)
    found = lines.repeats(documents_of(docs))
    assert sorted(tuple(r) for r in found.collect()) == brute(docs)


def test_short_lines_are_compared_for_equality(documents_of):
    docs = [(1, "Home\n\nall rights reserved here\none two three four five"), (2, "home\n \nall rights reserved there\none two three four"), (3, "all rights reserved here\none two three four six")]
    found = lines.repeats(documents_of(docs), equal_words=1)
    assert sorted(tuple(r) for r in found.collect()) == [(2, 0, "equal", 1, 0), (3, 0, "equal", 1, 2), (3, 1, "near", 1, 3)]


def test_within_one_is_an_edit_distance():
    rng = random.Random(5)
    for _ in range(3_000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert lines.within_one(a, b) == (distance(a, b) <= 1)


def test_variants_are_the_hashes_of_shorter_lines():
    words = "a b a a c d".split()
    hashes = lines.Hashes(pa.array(words), np.array([0, 6]))
    for at, key in enumerate(hashes.variants()):
        shorter = words[:at] + words[at + 1 :]
        assert lines.Hashes(pa.array(shorter), np.array([0, 5])).whole(1)[0] == key


def test_dropping_lines(documents_of):
    docs = [*EDGES, (20, "one two three four five\nshort"), (21, "one two three four five"), (22, "one two three four six\nkept here"), (23, "One two three four five\nshort")]
    frame = documents_of(docs)
    kept = lines.drop_repeats(frame)
    assert kept.columns == frame.columns
    found = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert found[22] == ("kept here", 9) and found[23] == ("short", 5) and found[20][0] == docs[8][1]
    assert 21 not in found and {None, 1, 2, 3, 4, 5, 6} <= set(found) and found[1] == (None, None)
    assert kept.filter("doc_id = 4").count() == 2
    assert lines.repeats(frame.filter(F.lit(False))).count() == 0


def test_text_helpers_split_like_the_contract():
    words, starts = texts.split_words(pa.array(["A\x0bb\t c d", None, "", "É x"]))
    assert words.to_pylist() == ["a", "b", "c d", "É", "x"] and starts.tolist() == [0, 3, 3, 3, 5]


def test_texts_that_share_an_id_lose_no_line(documents_of):
    line = "one two three four five six"
    rows = [(1, line), (5, f"{line}\nrest of it"), (5, "a unique line of other words\nmore"), (6, f"{line}\nthe last words"), (6, f"{line}\nthe last words"), (8, line)]
    kept = sorted((r.doc_id, r.text) for r in lines.drop_repeats(documents_of(rows)).collect())
    assert kept == [(1, line), (5, "a unique line of other words\nmore"), (5, f"{line}\nrest of it"), (6, "the last words"), (6, "the last words")]
