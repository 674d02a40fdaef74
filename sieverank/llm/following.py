"""Which frequent word follows, predicted bit by bit from the words before.

The most frequent training tokens have a number of their own, all others together have one more. A text is
the sequence of these numbers, written in the bits of a Huffman code over them. Contexts of a bit are the
code's node alone and hashed with the word before, with the two words before, and with the last two
frequent words before, however far back; a rare word stands in a context for its ending. Counts of the
training texts are summed in tables of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from sieverank.llm import bits, texts, units
from sieverank.llm.bits import GATES, Code, Model, Sums, stretched, stretched_without, summed_tables, table_rows, without

#: How many tokens have a number, and how long such a token may be; both bound what is broadcast.
FREQUENT, FREQUENT_BYTES = 4_096, 64
ENDINGS = 1 << 12
#: Table sizes as powers of two: the node alone, with the word before, with two, with the last two frequent ones.
BITS = (13, 20, 20, 20)
ORDERS = len(BITS)
#: Which of the words before a token each order knows: the last, the one before it, the last two frequent ones.
ROWS, EVERY = ((), (0,), (0, 1), (2, 3)), (0, 1, 2, 3)
SLOTS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
STEP_BITS = 1 << 14
STEP_TOKENS = 1 << 16
#: So many tokens or more, if there are, are counted and learned from together.
SEQUENCE_TOKENS = 1 << 21
END = "\n"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_START = np.uint64(1 << 20)


def symbols(words: pa.Array, frequent: pa.Array) -> np.ndarray:
    """A frequent word's number; for any other word the number of frequent words plus a hash of its last three bytes."""
    number = pc.fill_null(pc.index_in(words, value_set=frequent), len(frequent)).to_numpy(zero_copy_only=False).astype(np.int64)
    data, places = units.raw(words)
    ending = np.zeros(len(words), np.uint64)
    for back in range(1, 4):
        there = np.diff(places) >= back
        byte = np.zeros(len(words), np.uint64)
        byte[there] = data[places[1:][there] - back].astype(np.uint64) + np.uint64(1)
        ending = (ending + byte) * _A
        ending ^= ending >> np.uint64(29)
    rare = number == len(frequent)
    number[rare] += (ending[rare] % np.uint64(ENDINGS)).astype(np.int64)
    return number


def _hashed(first: np.ndarray, second: np.ndarray, salt: int) -> np.ndarray:
    mixed = (first + second * _B + np.uint64(salt << 40)) * _A
    return (mixed ^ (mixed >> np.uint64(31))) * _B


def _new(ordered: np.ndarray) -> np.ndarray:
    """Whether values are not those before them."""
    return np.append([True], ordered[1:] != ordered[:-1])[: len(ordered)]


class Sequences:
    """The symbols of texts laid end to end, ``starts`` telling where each begins, and what stands before each.

    ``before`` is the word before, the one before that, and the last two frequent words; where there is none, a
    number behind all that may stand there.
    """

    def __init__(self, symbol: np.ndarray, starts: np.ndarray, code: Code):
        size, self.code, frequent = len(symbol), code, len(code.length) - 1
        self.coded = np.minimum(symbol, frequent)
        self.symbols = np.argsort(-code.length, kind="stable")
        self.ranks = np.argsort(self.symbols)
        starts = starts[starts < size]
        one, two, near, far = self.before = np.empty((4, size), np.uint16)
        one[1:], two[2:] = symbol[:-1], symbol[:-2]
        one[starts] = two[starts] = two[starts[starts + 1 < size] + 1] = frequent + ENDINGS
        known = self.coded < frequent
        passed = np.cumsum(known) - known
        own = passed - np.repeat(passed[starts], np.diff(np.append(starts, size)))
        held = np.concatenate([[0, 0], symbol[known]]).astype(np.uint16)
        near[:] = np.where(own > 0, held.take(passed + 1), frequent)
        far[:] = np.where(own > 1, held.take(passed), frequent)

    def keys(self, *rows: int) -> np.ndarray:
        """One number for what a token is and what is in some rows of ``before``; longer codes have smaller ones."""
        keys = self.ranks[self.coded]
        for row in rows:
            keys *= self.radix(row)
            keys += self.before[row]
        return keys

    def radix(self, row: int) -> int:
        """How many values there are in a row of ``before``; with those of all rows, keys stay below 2 ** 63."""
        return len(self.code.length) + (ENDINGS if row < 2 else 0)

    def parted(self, keys: np.ndarray, *rows: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """What tokens are and what is in the rows, from their keys."""
        before = {}
        for row in rows[::-1]:
            higher = keys // self.radix(row)
            before[row] = keys - higher * self.radix(row)
            keys = higher
        return self.symbols[keys], before

    def distinct(self, keys: np.ndarray, *rows: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
        """Of sorted keys up to ``STEP_BITS`` distinct ones at a time: which, how often each occurs, and its parts."""
        first = np.flatnonzero(_new(keys))
        often = np.diff(np.append(first, len(keys)))
        for start in range(0, len(first), STEP_BITS):
            part = slice(start, start + STEP_BITS)
            yield part, often[part], *self.parted(keys[first[part]], *rows)

    def bits(self, keys: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of sorted keys of all rows, per place in the code and step: which distinct ones, how often each occurs, bits, and slots in each order's table."""
        for whole, often, coded, before in self.distinct(keys, *EVERY):
            contexts = [self.context(order, before) for order in range(1, ORDERS)]
            for part, node, bit, salt in _bits(coded, self.code):
                slots = [node, *(_slots(context[part], salt, order) for order, context in enumerate(contexts, 1))]
                yield slice(whole.start, whole.start + part.stop), often[part], bit, slots

    def context(self, order: int, before: dict[int, np.ndarray]) -> np.ndarray:
        """An order's hashed context, from rows of ``before``."""
        first, *more = (np.where(before[row] == self.radix(row) - 1, _START, before[row].astype(np.uint64)) for row in ROWS[order])
        return _hashed(first, more[0] if more else np.zeros(len(first), np.uint64), order)


def _bits(coded: np.ndarray, code: Code) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Per place in the code: which symbols have a bit there, nodes, bits, salts. Codes become no longer."""
    more = np.bincount(code.length[coded], minlength=1)[::-1].cumsum()[::-1]
    for nth, count in enumerate(more[1:].tolist()):
        node = code.node[nth].take(coded[:count])
        yield slice(count), node, code.bit[nth].take(coded[:count]), (node.astype(np.uint64) + np.uint64(1)) * _B


def _slots(context: np.ndarray, salt: np.ndarray, order: int) -> np.ndarray:
    mixed = context ^ salt
    mixed *= _A
    mixed >>= np.uint64(64 - BITS[order])
    return mixed.view(np.int64)


def _levels(near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much the word before (in four steps) and the two words before (in eight) have seen, from what they counted."""
    return np.minimum(np.log2(1 + near) / 4, 3).astype(np.uint8), np.minimum(np.log2(1 + far), 7).astype(np.uint8)


def counted(sequences: Sequences, table: np.ndarray) -> None:
    """Adds every bit to the joint table (slots, 2); what follows the same words again is added at once."""
    for order, rows in enumerate(ROWS):
        flat = table[SLOTS[order] : SLOTS[order + 1]].reshape(-1)
        for _, often, coded, before in sequences.distinct(np.sort(sequences.keys(*rows)), *rows):
            often = often.astype(np.float64)
            context = sequences.context(order, before) if rows else None
            for part, node, bit, salt in _bits(coded, sequences.code):
                slot = _slots(context[part], salt, order) if rows else node
                np.add.at(flat, slot * 2 + bit, often[part])


def _joined(lines: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Predictions and levels of the same slots, to be looked up together."""
    found = np.empty(lines.shape, np.complex64)
    found.real, found.imag = lines, levels
    return found


def _looked_up(slots: list[np.ndarray], plain: list[np.ndarray], joined: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(orders, bits) predictions and the gates, from tables by order: the first and last, and those between with levels."""
    inputs = np.empty((ORDERS, len(slots[0])), np.float32)
    near, far = (table.take(slot) for table, slot in zip(joined, slots[1:3], strict=True))
    inputs[0], inputs[1], inputs[2], inputs[3] = plain[0].take(slots[0]), near.real, far.real, plain[1].take(slots[3])
    return inputs, (far.imag * 4 + near.imag).astype(np.int64)


class Own:
    """The tables as predictions of a bit that is counted in them, and levels of what else was seen: (slots, 2), by the bit."""

    def __init__(self, table: np.ndarray):
        near, far = np.empty((2, SLOTS[2] - SLOTS[1], 2), np.uint8)
        for bit in range(2):
            seen = (without(table[SLOTS[order] : SLOTS[order + 1]], bit).sum(axis=1) for order in (1, 2))
            near[:, bit], far[:, bit] = _levels(*seen)
        lines = [stretched_without(table[a:b]) for a, b in zip(SLOTS[:-1], SLOTS[1:], strict=True)]
        self.plain, self.joined = [lines[0], lines[3]], [_joined(lines[1], near), _joined(lines[2], far)]

    def gather(self, sequences: Sequences, sums: Sums) -> None:
        """Adds every bit to what weights and map are made of, predicted from counts less its own occurrence."""
        for _, often, bit, slots in sequences.bits(np.sort(sequences.keys(*EVERY))):
            inputs, gate = _looked_up([slot * 2 + bit for slot in slots], self.plain, self.joined)
            sums.add(inputs, gate, bit, often)


def gathered(sequences: Sequences, table: np.ndarray, sums: Sums) -> None:
    """``Own.gather`` from a table of counts."""
    Own(table).gather(sequences, sums)


class Ready:
    """The tables as predictions and levels of what was seen, for scoring."""

    def __init__(self, table: np.ndarray, model: Model):
        lines, self.model = [stretched(table[a:b]) for a, b in zip(SLOTS[:-1], SLOTS[1:], strict=True)], model
        seen = table[:, 0] + table[:, 1]
        near, far = _levels(seen[SLOTS[1] : SLOTS[2]], seen[SLOTS[2] : SLOTS[3]])
        self.plain, self.joined = [lines[0], lines[3]], [_joined(lines[1], near), _joined(lines[2], far)]

    def cost(self, sequences: Sequences) -> np.ndarray:
        """log10 of the probability of each place's number."""
        keys = sequences.keys(*EVERY)
        order = np.argsort(keys)
        keys = keys[order]
        total = np.zeros(len(keys))
        for part, _, bit, slots in sequences.bits(keys):
            total[part] += self.model.cost(*_looked_up(slots, self.plain, self.joined), bit)
        found = np.empty(len(keys))
        found[order] = total[np.cumsum(_new(keys)) - 1]
        return found


def _read(batches: Iterator[pa.RecordBatch], frequent: pa.Array, code: Code) -> Iterator[Sequences]:
    """The texts of the batches, each with its end."""
    end = symbols(pa.array([END]), frequent)[0]
    held, size = [], 0
    for block in texts.blocks(batches, "text"):
        words, starts = texts.split_words(block.column("text"))
        coded = words.dictionary_encode()
        symbol = symbols(coded.dictionary, frequent).astype(np.uint16)[coded.indices.to_numpy(zero_copy_only=False)]
        held.append((np.insert(symbol, starts[1:], end), size + starts[:-1] + np.arange(len(starts) - 1)))
        size += len(held[-1][0])
        if size >= SEQUENCE_TOKENS:
            yield Sequences(*map(np.concatenate, zip(*held, strict=True)), code)
            held, size = [], 0
    if held:
        yield Sequences(*map(np.concatenate, zip(*held, strict=True)), code)


def counts_of(training: DataFrame, frequent: pa.Array, code: Code) -> np.ndarray:
    """The joint table over all training texts, read where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SLOTS[-1], 2))
        for sequences in _read(batches, frequent, code):
            counted(sequences, table)
        yield from table_rows(table)

    return summed_tables(training, run, SLOTS[-1])


def learned(training: DataFrame, share: Column, own, frequent: pa.Array, code: Code) -> Model:
    """Weights and map, from all training texts and the broadcast ``Own`` of their table."""

    def gather(batches: Iterator[pa.RecordBatch], sums: Sums) -> None:
        for sequences in _read(batches, frequent, code):
            own.value.gather(sequences, sums)

    return bits.learned(training, share, gather, GATES, ORDERS)
