"""Benchmark decontamination: CGK embeddings of word sequences, bit-sampling LSH, exact verification.

A CGK walk reads a sequence with a pointer that stays or moves on by a random bit of the step and the
symbol, and writes the symbol under the pointer at every step. Sequences at a small edit distance give
walks at a small Hamming distance, so walks that agree in a few sampled steps are worth comparing.
Items are embedded from every second word on, and every word of every document starts a walk, so an
item-sized window is compared part by part and edits in one part do not hide the others. Windows that
share the samples of some table are verified: first by the word pairs that so few edits must leave,
then by the exact edit distance in words.

Walks are too short to sample in items of few words. Items of up to ``WHOLE`` words, and all that are in no
table of walks, are found by their words instead, without loss: by parts, one more than edits, of
which one must be left. With one edit and few words these would be everyday words, so there two of
three parts have to be left, next to each other or with the gap that the edit may have made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm import texts

SIMILARITY = 0.8
TABLES, SAMPLES, SPAN, STRIDE = 8, 6, 8, 2
WHOLE, RUN = 25, 9
MAX_ITEMS_BYTES = 32 << 20
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def allowed(words: int, similarity: float) -> int:
    """Edits an item of so many words may differ by."""
    return int((1 - similarity) * words + 1e-9)


def plain_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of letters and digits (and whatever is not ASCII), A-Z made small, and each text's start."""
    mapped = texts.mapped(column)
    _, offsets, data = mapped.buffers()
    if len(mapped) == 0 or data is None:
        return texts.split_words(mapped)
    bare = pa.StringArray.from_buffers(len(mapped), offsets, pa.py_buffer(memoryview(data).tobytes().translate(_PLAIN)))
    return texts.split_words(bare)


def passage_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edits between the item and the part of the text next to it, and that part (first, shortest wins)."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    places = np.arange(n + 1)
    for word in item:
        step = np.empty(n + 1, np.int64)
        origin = np.empty(n + 1, np.int64)
        step[0], origin[0] = cost[0] + 1, start[0]
        replaced, dropped = cost[:-1] + (text != word), cost[1:] + 1
        # Of equal costs the later start wins, which is the shorter part.
        better = (replaced < dropped) | ((replaced == dropped) & (start[:-1] >= start[1:]))
        step[1:], origin[1:] = np.where(better, replaced, dropped), np.where(better, start[:-1], start[1:])
        # A run of inserted words costs one each: a running minimum of cost minus place.
        lead = (step - places) * (n + 2) - origin
        best = np.minimum.accumulate(lead)
        low = -((-best) // (n + 2))
        moved = low + places < step
        origin = np.where(moved, low * (n + 2) - best, origin)
        cost, start = np.minimum(step, low + places), origin
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def walk(words: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(steps, words): what walks write that start at each word; 0 beyond the end."""
    padded = np.append(words, 0).astype(np.int32)
    at = np.arange(len(words), dtype=np.int64)
    out = np.empty((len(moves), len(words)), np.int32)
    for step, move in enumerate(moves):
        out[step] = padded[at]
        at = np.minimum(at + move[out[step]], len(words))
    return out


def _mixed(samples: np.ndarray) -> np.ndarray:
    """One key per column of sampled symbols."""
    key = np.zeros(samples.shape[1], np.uint64)
    for row in samples:
        key = (key ^ row.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _runs(words: np.ndarray, most: int) -> list[np.ndarray]:
    """Per length up to ``most`` a key of the words from each place on; 0 stands for words beyond the end."""
    padded = np.append(words, np.zeros(most, np.int32)).astype(np.uint64)
    base = (padded + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    base ^= base >> np.uint64(31)
    keys = [np.zeros(len(words), np.uint64)]
    for length in range(1, most + 1):
        key = (keys[-1] + base[length - 1 : length - 1 + len(words)]) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(key ^ key >> np.uint64(29))
    return keys


def _shaped(runs: list[np.ndarray], shape: tuple[int, int, int]) -> np.ndarray:
    """A key per place: of so many words, and after so many others, of so many more."""
    first, gap, second = shape
    key = runs[first]
    if second:
        later = np.zeros(len(key), np.uint64)
        later[: max(0, len(key) - first - gap)] = runs[second][first + gap :]
        key = (key ^ later * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ key >> np.uint64(32)
    return key


def _one_edit_shapes(size: int) -> list[tuple[tuple[int, int, int], tuple[int, int, int], int]]:
    """(shape in the text, shape in the item, place in the item): one edit leaves one of them at least."""
    a = (size + 1) // 3
    b = size - a
    shapes = [((b, 0, 0), (b, 0, 0), 0), ((size - a, 0, 0), (size - a, 0, 0), a)]
    return shapes + [((a, b - a + s, size - b), (a, b - a, size - b), 0) for s in (-1, 0, 1) if a and b - a + s >= 0]


class Items:
    """Benchmark items as word ids, with the sampled walks of their parts in every table.

    Tables are of two kinds: for items of ``SPAN`` words and more, sampled from the walk over a part,
    and for each shorter length, from the walk over the whole item. ``shapes`` are the tables of words:
    per shape the keys, which leading bits of keys there are, and the items and places of the keys.
    """

    def __init__(self, rows: list[tuple[int, str]], similarity: float, tables: int, samples: int, seed: int = 7):
        words, starts = plain_words(pa.array([t for _, t in rows], pa.string()))
        coded = words.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        full = [(k, ids[a:b]) for (k, _), a, b in zip(rows, starts[:-1], starts[1:], strict=True) if b > a]
        self.vocabulary = coded.dictionary
        self.top = len(self.vocabulary) + 1
        self.keys, self.words = [k for k, _ in full], [w for _, w in full]
        self.edits = [allowed(len(w), similarity) for w in self.words]
        self.pairs = [np.sort(_pairs(w, self.top)) for w in self.words]
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (2 * SPAN, self.top), dtype=np.int8)
        self.tables = []
        short = np.array([len(w) <= WHOLE for w in self.words], bool)
        walked = np.zeros(len(self.words), bool)
        for span in sorted({min(len(w), SPAN) for w, s in zip(self.words, short, strict=True) if not s}):
            members = [i for i, w in enumerate(self.words) if min(len(w), SPAN) == span and not short[i]]
            parts = [(i, at) for i in members for at in range(0, len(self.words[i]) - span + 1, STRIDE)]
            walks = {i: walk(self.words[i], self.moves) for i in members}
            written = np.stack([walks[i][:, at] for i, at in parts], axis=1)
            for _ in range(tables):
                steps = np.sort(rng.choice(2 * span, min(samples, 2 * span), replace=False))
                # A walk of a short item may end before a late step: such samples cannot be asked for.
                keys = _mixed(written[steps])
                good = (written[steps] > 0).all(axis=0)
                order = np.argsort(keys[good], kind="stable")
                kept = np.flatnonzero(good)[order]
                masks = []
                for step in steps[:2]:
                    mask = np.zeros(self.top, bool)
                    mask[written[step][kept]] = True
                    masks.append(mask)
                placed = np.array(parts, np.int64).reshape(-1, 2)[kept]
                walked[placed[:, 0]] = True
                self.tables.append((steps, masks, keys[kept], placed))
        self.shapes = self._shapes(short, walked)

    def _shapes(self, short: np.ndarray, walked: np.ndarray) -> list[tuple]:
        members: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero(short | ~walked):
            words, edits = self.words[i], self.edits[i]
            if edits == 1 and len(words) <= RUN:
                shapes = _one_edit_shapes(len(words))
            else:
                cuts = np.linspace(0, len(words), min(edits + 1, len(words)) + 1).astype(int)
                sizes = np.minimum(np.diff(cuts), RUN).tolist()
                shapes = [((n, 0, 0), (n, 0, 0), int(at)) for n, at in zip(sizes, cuts[:-1], strict=True)]
            runs = _runs(words, RUN)
            for shown, own, at in shapes:
                members.setdefault(shown, []).append((int(_shaped(runs, own)[at]), int(i), at))
        found = []
        for shape, rows in sorted(members.items()):
            keys = np.array([key for key, *_ in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            bits = min(24, max(16, len(keys).bit_length() + 4))
            there = np.zeros(1 << bits, bool)
            there[keys >> np.uint64(64 - bits)] = True
            found.append((shape, there, np.uint64(64 - bits), keys[order], np.array([row[1:] for row in rows], np.int64)[order]))
        return found


def _pairs(words: np.ndarray, top: int) -> np.ndarray:
    """A key per pair of neighbouring words; -1 if one of them is in no item."""
    left, right = words[:-1].astype(np.int64), words[1:].astype(np.int64)
    return np.where((left > 0) & (right > 0), left * top + right, -1)


def _matches(keys: np.ndarray, mine: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``keys``, place in the text) of every key at the places ``live`` that is in the sorted ``keys``."""
    first = np.searchsorted(keys, mine, side="left")
    hit = keys[np.minimum(first, len(keys) - 1)] == mine
    live, first = live[hit], first[hit]
    count = np.searchsorted(keys, mine[hit], side="right") - first
    rows = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else first
    return rows, np.repeat(live, count)


def candidates(words: np.ndarray, starts: np.ndarray, items: Items) -> np.ndarray:
    """(n, 3): item, where its first word would stand, and the text of the match, for windows that share a key of a table."""
    def distinct(chosen: np.ndarray, live: np.ndarray) -> np.ndarray:
        owner = np.searchsorted(starts, live, side="right") - 1
        return np.stack([chosen[:, 0], live - chosen[:, 1], owner], axis=1)

    found = []
    written = walk(words, items.moves) if items.tables else None
    for steps, masks, keys, parts in items.tables:
        if not len(keys):
            continue
        live = np.flatnonzero(masks[0][written[steps[0]]])
        if len(steps) > 1:
            live = live[masks[1][written[steps[1]][live]]]
        mine = _mixed(np.stack([written[step][live] for step in steps]))
        rows, live = _matches(keys, mine, live)
        chosen = parts[rows]
        found.append(distinct(chosen, live))
    runs = _runs(words, max((max(shape[0], shape[2]) for shape, *_ in items.shapes), default=0))
    for shape, there, shift, keys, parts in items.shapes:
        mine = _shaped(runs, shape)
        live = np.flatnonzero(there[mine >> shift])
        rows, live = _matches(keys, mine[live], live)
        chosen = parts[rows]
        found.append(distinct(chosen, live))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def leaks(words: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, end) of every text and item that a candidate window verifies."""
    rows = candidates(words, starts, items)
    if not len(rows):
        return
    pairs = np.append(_pairs(words, items.top), -1)
    before = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]])
    for a, b in zip(before[:-1], before[1:], strict=True):
        item, places, matched = int(rows[a, 0]), rows[a:b, 1], rows[a:b, 2]
        size, edits = len(items.words[item]), items.edits[item]
        # Each edit spoils two pairs at most; the others stand within the window.
        need = size - 1 - 2 * edits
        if need > 0:
            window = places[:, None] - edits + np.arange(size + 2 * edits - 1)
            shown = pairs[np.clip(window, 0, len(pairs) - 1)]
            place = np.minimum(np.searchsorted(items.pairs[item], shown), len(items.pairs[item]) - 1)
            enough = (items.pairs[item][place] == shown).sum(axis=1) >= need
            places, matched = places[enough], matched[enough]
        best: dict[int, tuple[int, int, int]] = {}
        owner = np.searchsorted(starts, np.clip(places, 0, len(words) - 1), side="right") - 1
        # A place before the text's first word belongs to the text of the window's later words too.
        late = np.searchsorted(starts, np.clip(places + size - 1, 0, len(words) - 1), side="right") - 1
        # Of a text that lacks the item's ends the first and the last word lie in its neighbours.
        both = {(int(o), int(p)) for owners in (owner, late, matched) for o, p in zip(owners, places, strict=True)}
        done: dict[int, int] = {}
        for text, place in sorted(both):
            low, high = max(int(starts[text]), place - edits), min(int(starts[text + 1]), place + size + edits)
            if high <= low or (text in done and place <= done[text]):
                continue
            # Neighbouring places are verified together: the region reaches over the next few.
            high = min(int(starts[text + 1]), high + edits)
            done[text] = place + edits
            cost, at, end = passage_distance(items.words[item], words[low:high])
            if cost <= edits and (text not in best or cost < best[text][0]):
                best[text] = cost, low + at, low + end
        for text, (cost, at, end) in best.items():
            yield text, item, cost, at - int(starts[text]), end - int(starts[text])


def find(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, samples: int = SAMPLES,
) -> DataFrame:
    """(doc_id, item_id, edits, first_word, end_word) for every text that holds a passage of an item.

    A passage is a part of the text within floor((1 - similarity) * words of the item) inserted, deleted
    or replaced words of it; words are compared without case (A-Z) and ASCII punctuation. The best passage of
    a text and item is given, the earliest of equals. Items without words, null texts and null
    item ids find nothing; repeated items and rows are found each; a null doc_id stays null; empty
    tables give no rows; other columns take no part. Items go to every task: their texts are checked
    to be under ``MAX_ITEMS_BYTES``, and several passes over parts of them are made beyond that.
    """
    spark = documents.sparkSession
    texts.prepare(spark)
    bare = texts.with_text(documents)
    found = None
    for part in _parts(benchmark):
        rows = [(r["item_id"], r["text"]) for r in part.collect()]  # within MAX_ITEMS_BYTES by the sizes counted
        one = _found(bare, Items(rows, similarity, tables, samples))
        found = one if found is None else found.union(one)
    return found


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items by hash, in as many parts as keep each within half of MAX_ITEMS_BYTES on average."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-2 * size // MAX_ITEMS_BYTES))
    if count == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i) for i in range(count)]


def _found(bare: DataFrame, items: Items) -> DataFrame:
    shared = bare.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for block in texts.blocks(batches, "text", 1 << 20):
            ids = block.column("doc_id").to_pylist()
            words, starts = plain_words(block.column("text"))
            rows = []
            if len(words) and items.words:
                coded = words.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, value_set=items.vocabulary), -1).to_numpy(zero_copy_only=False)
                symbols = (known.astype(np.int32) + 1)[coded.indices.to_numpy(zero_copy_only=False)]
                rows = [(ids[t], items.keys[i], *rest) for t, i, *rest in leaks(symbols, starts, items)]
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "first_word", "end_word"])

    return bare.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, end_word long")


def keep_clean(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without a passage of any item, with all their columns. Rows without id stay."""
    gone = find(documents, benchmark, similarity).select(F.col("doc_id").alias("__sieverank_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["__sieverank_gone"], "left_anti")
