import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieverank.llm import alignment, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOOLS = alignment.Tokenizers(A, B)
SIGNS = list("aZb9(.,<é日🎉ａﬁ▁'́ 　 \t\n\x00\x7f  ") + ["  ", "the ", " <0x41>", "<|endoftext|>", "<s>", "한국", " don't", "123"]


def whole(text):
    """Groups (a ids, b ids) and links of a text encoded as one, by the lengths of its tokens' bytes."""
    if not text:
        return [], []
    a, b = TOOLS.a.encode(" " + text, add_special_tokens=False).ids, TOOLS.b.encode(text)
    a_bytes, b_bytes = [TOOLS.a_bytes[i].as_py() for i in a], [TOOLS.b_bytes[i].as_py() for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], []
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    found, links, i, j = [], [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        of_a, of_b = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        found.append((a[i:of_a], b[j:of_b], end))
        links.append((a[of_a - 1], b[of_b - 1]))
        i, j = of_a, of_b
    return found, links


def digest(found):
    said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in found)
    return hashlib.sha256(said.encode()).hexdigest() if found else ""


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS) | st.characters(exclude_categories=["Cs"]), max_size=10).map("".join), min_size=1, max_size=5))
def test_units_give_the_groups_of_whole_texts(some):
    assert digests([*some, None], MEMORY) == [digest(whole(t)[0]) for t in [*some, None]]


MEMORY = alignment.Memory()


def digests(some, memory):
    found, starts = units.split_units(pa.array(some, pa.string()))
    distinct, codes = units.coded(found)
    known = memory.look_up(distinct, TOOLS)
    return alignment._digests(known.words, codes, starts, alignment._good(known.ok, codes, starts))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MAX_KNOWN", 3)
    memory = alignment.Memory()
    for some in (["a b c d"], ["a x▁y"], ["a b", "e f g h"], ["a, b"]):
        assert digests(some, memory) == [digest(whole(t)[0]) for t in some]
    assert len(memory.number) < 8


def test_units_are_the_text():
    some = ["", "a b", " a  b ", "a\n b", "x 　y z", "é a", None, "a"]
    found, starts = units.split_units(pa.array(some))
    joined = ["".join(found[starts[i] : starts[i + 1]].to_pylist()) for i in range(len(some))]
    assert joined == [" " + t if t else "" for t in some] and starts[-1] == len(found)
    assert units.split_units(pa.array(["don't (a,b) 12ab x's'y"]))[0].to_pylist() == [" don", "'t", " (", "a", ",", "b", ")", " 12", "ab", " x", "'s", "'y"]


def test_very_long_texts_are_digested_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "DIGESTED_AT_ONCE", 7)
    some = ["a b c d e f g h i j k l m n o p q r s t u v", "x y", None, "z " * 40, "one two"]
    assert digests(some, MEMORY) == [digest(whole(t)[0]) for t in some]


def brute(rows):
    count = Counter(link for _, t in rows for link in whole(t)[1])
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    found = []
    for i, t in rows:
        parts, links = whole(t)
        best = sum(count[x] == highest[x[1]] for x in links)
        found.append((i, sum(len(a) for a, _, _ in parts), sum(len(b) for _, b, _ in parts), len(parts), digest(parts), len(links), best, sum(count[x] for x in links)))
    return sorted(found, key=str), count


ROWS = [*EDGES, (8, "x▁y"), (9, "naïve ａ 日本語 🎉\t don't"), (10, "  two  spaces "), (10, "another text of ten"), *[(20 + i % 7, "the same text " * (i % 5)) for i in range(60)]]


def test_counts_equal_brute_force(documents_of):
    want, count = brute(ROWS)
    frame = documents_of(ROWS).repartition(5)
    assert sorted((tuple(r) for r in alignment.align(frame, A, B).collect()), key=str) == want
    assert {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(frame, A, B).collect()} == count


def test_spans(documents_of):
    rows = [(i, t) for i, t in enumerate(["naïve ａ 日本語", None, "x▁y", "a  b", "", "the end " * 50])]
    got = {}
    for r in alignment.groups(documents_of(rows).coalesce(1), A, B).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        want = whole(text)[0]
        mine = sorted(got.get(i, []), key=lambda r: r["group"])
        assert [(r["a_ids"], r["b_ids"], r["end"]) for r in mine] == want
        assert [r["start"] for r in mine] == [0, *[e for _, _, e in want]][: len(want)]
        assert [r["group"] for r in mine] == list(range(len(want)))


def test_spans_are_numbered_by_text(documents_of):
    block = alignment.groups(documents_of([(1, "a b c"), (2, "d e f g")]).coalesce(1), A, B).collect()
    assert [(r.doc_id, r.group) for r in block] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_empty_table(documents_of):
    assert alignment.align(documents_of(EDGES).filter(F.lit(False)), A, B).count() == 0
    assert [tuple(r) for r in alignment.align(documents_of([(1, None), (1, "")]), A, B).collect()] == [(1, 0, 0, 0, "", 0, 0, 0)] * 2
