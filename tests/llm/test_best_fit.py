import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieverank.llm import best_fit

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZ9é́̈́'.-< |>Σς日\t\n\x0b\x85  　\x1c ")) | st.characters(exclude_categories=["Cs"]), max_size=12), max_size=4))
def test_words_give_the_ids_of_the_whole_text(parts):
    found, starts = best_fit.encoded(pa.array([*parts, "<|endoftext|> x"], pa.string()), PATH)
    for i, text in enumerate([*parts, "<|endoftext|> x"]):
        assert found[starts[i] : starts[i + 1]].tolist() == ids_of(text)


def squares(sizes, room):
    """The method, with the sum of squares itself taken anew for every choice."""
    gaps, chosen = [], [0] * len(sizes)
    def score(g):
        _, n = np.unique([x for x in g if x > 0], return_counts=True)
        return int((n**2).sum())
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = sorted({g for g in gaps if g >= sizes[i]})
        if fitting:
            tried = [(score([*gaps[: gaps.index(g)], *gaps[gaps.index(g) + 1 :], g - sizes[i]]), g) for g in fitting]
            gap = min(tried)[1]
            gaps[gaps.index(gap)] -= sizes[i]
        else:
            gap = room
            gaps.append(room - sizes[i])
        chosen[i] = gap
    return chosen, len(gaps)


def test_squares_decide():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 13, rng.integers(1, 40))
        chosen, offset = best_fit.fill(sizes, 12)
        gaps, bins = squares(sizes.tolist(), 12)
        assert (12 - offset).tolist() == gaps and len(set(chosen.tolist())) == bins


def check(rows, found, room):
    placed = {}
    for r in found:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= room
    want = []
    for doc_id, text in rows:
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), room)):
            part = ids[start : start + room]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    return placed


def test_every_id_has_one_place(documents_of):
    rows = [*EDGES, (7, "<|endoftext|>"), *[(100 + i, "word " * (i % 60)) for i in range(300)]]
    found = best_fit.pack(documents_of(rows), PATH, max_tokens=64).collect()
    placed = check(rows, found, 64)
    assert len(placed) == -(-sum(r["length"] for r in found) // 64)


def test_slices_are_filled_alone(documents_of):
    rows = [(7, "the same text of a hot id") for _ in range(400)] + [(None, "a b c")] * 200
    found = best_fit.pack(documents_of(rows), PATH, max_tokens=64, slice_pieces=50).collect()
    placed = check(rows, found, 64)
    slices = {}
    for r in found:
        slices[r["sequence_id"] >> 32] = slices.get(r["sequence_id"] >> 32, 0) + 1
    assert len(slices) == 12 and max(slices.values()) < 100
    assert len(placed) <= sum(r["length"] for r in found) // 64 + 12 * 2


def test_sequences_hold_their_ids(documents_of):
    rows = [(i, "some words here " * (i % 9)) for i in range(60)] + [(5, None)]
    found = best_fit.sequences(documents_of(rows), PATH, max_tokens=32).collect()
    assert all(len(r["ids"]) <= 32 for r in found)
    assert sorted(i for r in found for i in r["ids"]) == sorted(i for _, t in rows for i in ids_of(t))


def test_empty_table(documents_of):
    assert best_fit.pack(documents_of(EDGES).filter(F.lit(False)), PATH).count() == 0


def test_units_go_many_to_a_text(monkeypatch):
    """A text costs the tokenizer as much again as a unit; what is unclear goes alone, and other tokenizers' units do."""
    rng = random.Random(8)
    units = list(dict.fromkeys("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 12))) for _ in range(3_000)))
    units += ["7", "0", "...", "!?", "it's", "'s", "<|endoftext|>", "größe", "日本", "\x01", "é", "　", "</w>", "w>"]
    whole, sent = best_fit._tokenizer(PATH), []

    class Counting:
        model, get_vocab = whole.model, whole.get_vocab

        def encode_batch_fast(self, found, **kind):
            sent.extend(found)
            return whole.encode_batch_fast(found, **kind)

    want = {unit: whole.encode(unit, add_special_tokens=False).ids for unit in units}
    monkeypatch.setattr(best_fit, "_tokenizer", lambda path: Counting())
    best_fit._known(PATH).clear()
    ids, sizes = best_fit._ids_of(pa.array(units), PATH)
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == list(want.values())
    assert len(sent) < len(units) / 10
    monkeypatch.setattr(best_fit, "_last", lambda path: None)
    assert dict(best_fit._lists(units, PATH)) == want
    monkeypatch.setattr(best_fit, "_last", lambda path: np.ones(60_000, bool))  # no such ends
    assert dict(best_fit._lists(units, PATH)) == want
