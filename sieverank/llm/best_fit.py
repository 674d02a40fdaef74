"""Packing whole documents into sequences by sums of squares.

Documents become token ids, with one id behind each as its end. Only what is longer than a sequence is
cut. Pieces are placed longest first: each where the sum, over all residual gaps, of the squared number of
open bins with that gap becomes smallest; a new bin is opened where no open one has room. So gaps are kept
apart, and some bin fits whatever comes. Longest first and new bins last make up for the method's own
waste: on the given documents the number of sequences is that of the tokens divided by the length, rounded up.

Bins are filled slice by slice. Slices are dealt by a hash of the row's number, so that copies, hot ids and
rows without id fill none, and hold some ``SLICE_PIECES`` pieces whatever the size of the table: each
wastes less than one sequence, one in some 6,000 on the given documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.llm.units import coded, gathered, raw, spread
from sieverank.session import cut

MAX_TOKENS = 2048
END_ID = 0
SLICE_PIECES = 16_384
BLOCK_BYTES = 16 << 20
ENCODED_AT_ONCE = 10_000
JOINED = 100
MAX_KNOWN = 300_000

PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Kinds of bytes: letters, digits, other signs, and what is no clear case: an apostrophe, which may join letters
#: to itself, the sign that special tokens start with, controls, and parts of other characters.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = 1
_KIND[[*b"0123456789"]] = 2
_KIND[[*b"'<"]] = 4
_CLEAR = re.compile(r"[a-z]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")


def _taken_apart(words: pa.Array, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words as runs of letters, single digits and runs of signs, in lower case, and the places of texts in these.

    The tokenizer does the same to them. Words that hold no clear case stay whole, as they are.
    """
    data, starts = raw(words)
    data = data.copy()
    kind = _KIND[data]
    unclear = np.concatenate([[0], np.cumsum(kind == 4)])[starts]
    clear = np.repeat(np.diff(unclear) == 0, np.diff(starts))
    data[(data >= ord("A")) & (data <= ord("Z")) & clear] += 32
    cut_at = np.zeros(len(data) + 1, bool)
    cut_at[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & clear[1:]
    cut_at[starts] = True
    offsets = np.flatnonzero(cut_at)
    units = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return units, np.searchsorted(offsets, starts)[places]


@lru_cache(maxsize=2)
def _known(path: str) -> dict[str, list[int]]:
    """The ids of units a worker has met, until they are ``MAX_KNOWN``."""
    return {}


@lru_cache(maxsize=2)
def _last(path: str) -> np.ndarray | None:
    """Which ids end a unit, if the tokenizer tells."""
    tokenizer = _tokenizer(path)
    mark, vocabulary = getattr(tokenizer.model, "end_of_word_suffix", None), tokenizer.get_vocab()
    if not mark:
        return None
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[number for unit, number in vocabulary.items() if unit.endswith(mark)]] = True
    return last


def _lists(names: list[str], path: str) -> Iterator[tuple[str, list[int]]]:
    """Units and their ids. Runs of letters or signs, and digits, go many to a text: a text costs as much again as such a unit.

    Each of these is one word to the tokenizer, and its last id ends a word; where numbers of both differ, all go one by one.
    """
    tokenizer, last = _tokenizer(path), _last(path)
    alone, clear = [], []
    for unit in names:
        (clear if last is not None and _CLEAR.fullmatch(unit) else alone).append(unit)
    lines = [" ".join(clear[i : i + JOINED]) for i in range(0, len(clear), JOINED)]
    ids = list(chain.from_iterable(found.ids for found in tokenizer.encode_batch_fast(lines, add_special_tokens=False)))
    ends = (np.flatnonzero(last[np.array(ids)]) + 1).tolist() if ids else []
    if len(ends) == len(clear):
        yield from zip(clear, (ids[start:end] for start, end in zip([0, *ends], ends, strict=False)), strict=True)
    else:
        alone = names
    yield from zip(alone, (found.ids for found in tokenizer.encode_batch_fast(alone, add_special_tokens=False)), strict=True)


def _ids_of(units: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units end to end, and how many each has."""
    known, names = _known(path), units.to_pylist()
    if len(known) > MAX_KNOWN:
        known.clear()
    new = [u for u in names if u not in known]
    for start in range(0, len(new), ENCODED_AT_ONCE):
        some = new[start : start + ENCODED_AT_ONCE]
        known.update(_lists(some, path))
    lists = [known[u] for u in names]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def encoded(found: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, each with its end, and where each starts (one more entry than texts).

    Words between white space, and the parts of clear ones, are encoded once each: the tokenizer drops white
    space and never looks across it.
    """
    units, places = _taken_apart(*texts.split_words(found, lower=False))
    distinct, codes = coded(units)
    ids, sizes = _ids_of(distinct, path)
    # one more word, the end, behind the words of every text
    codes = np.insert(codes.astype(np.int64), places[1:], len(sizes))
    ids, sizes = np.append(ids, np.uint32(END_ID)), np.append(sizes, 1)
    entries, starts = spread(sizes, codes)
    return ids[entries], starts[places + np.arange(len(places))]


def pieces(documents: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32), and the ``ids`` if asked: every document's tokens, cut where it is too long.

    ``row`` numbers the pieces, in no order, and is one piece's own. The file named by ``tokenizer`` has to be
    readable by the executors; it must be one that drops white space.
    """
    texts.prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for block in gathered(batches, "text", BLOCK_BYTES):
            ids, starts = encoded(block.column("text").combine_chunks(), tokenizer)
            number = -(-np.diff(starts) // max_tokens)
            document = np.repeat(np.arange(len(number)), number)
            piece = np.arange(len(document)) - np.repeat(np.cumsum(number) - number, number)
            begin = piece * max_tokens
            length = np.minimum(np.diff(starts)[document] - begin, max_tokens)
            data, at = memoryview(ids.astype("<u4").view(np.uint8)), (starts[document] + begin) * 4
            check = [zlib.crc32(data[a:b]) for a, b in zip(at, at + 4 * length, strict=True)]
            columns = {
                "row": row + np.arange(len(piece)), "doc_id": block.column("doc_id").combine_chunks().take(pa.array(document)),
                "piece": piece.astype(np.int32), "start": begin, "length": length, "ids_crc32": pa.array(check, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32)))
            row += len(piece)
            yield pa.RecordBatch.from_pydict(columns)

    return texts.with_text(documents).mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def fill(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each size, and its offset there; sizes are taken longest first, in order where equal.

    ``bins[g]`` are the open bins with gap g. To place a size s at gap g makes that count one less and the
    count at g - s one more, so that their squares change by 2 (bins[g - s] - bins[g]) + 2; a bin that
    becomes full is open no more, and only the first part of it counts. Equal changes go to the smaller gap, and
    of its bins to the one that came to it last.
    """
    counts = np.zeros(room + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(room + 1)]
    chosen, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        left = np.flatnonzero(counts[size:])  # gaps that would remain
        if len(left):
            change = 2 * np.where(left > 0, counts[left] + 1, 0) - 2 * counts[left + size] + np.where(left > 0, 0, 1)
            after = int(left[int(change.argmin())])
            gap = after + size
            bin_, counts[gap] = bins[gap].pop(), counts[gap] - 1
        else:
            gap, after, bin_ = room, room - size, opened
            opened += 1
        chosen[i], offset[i] = bin_, room - gap
        if after:
            bins[after].append(bin_)
            counts[after] += 1
    return chosen, offset


def place(found: DataFrame, max_tokens: int = MAX_TOKENS, slice_pieces: int = SLICE_PIECES) -> DataFrame:
    """The pieces, a stored table, with ``sequence_id`` and ``offset``; ``row`` and ``length`` decide."""
    slices = max(1, -(-found.count() // slice_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        chosen, offset = fill(group.column("length").to_numpy(), max_tokens)
        number = group.column("slice").to_numpy() << 32
        return group.drop_columns("slice").append_column("sequence_id", pa.array(number + chosen)).append_column("offset", pa.array(offset))

    schema = f"{PIECE}, sequence_id long, offset long"
    dealt = found.select(*[c.split()[0] for c in PIECE.split(", ")], F.pmod(F.xxhash64("row"), F.lit(slices)).cast("long").alias("slice"))
    return dealt.groupBy("slice").applyInArrow(run, schema)


def pack(documents: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, slice_pieces: int = SLICE_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A null or empty text is its end alone. Equal rows, rows that share an id and rows without id are packed
    each; an empty table gives no rows; other columns take no part. ``sequence_id`` are any numbers;
    offsets in a sequence start from 0 without gaps.
    """
    return place(cut(pieces(documents, tokenizer, max_tokens), "pieces"), max_tokens, slice_pieces).drop("row")


def sequences(documents: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(sequence_id, doc_ids, offsets, ids): the packed sequences themselves, of up to ``max_tokens`` ids each."""
    found = cut(pieces(documents, tokenizer, max_tokens, with_ids=True), "pieces")
    placed = place(found, max_tokens).select("row", "sequence_id", "offset")
    part = F.struct("offset", "doc_id", "ids")
    whole = found.select("row", "doc_id", "ids").join(placed, "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select(
        "sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"), F.flatten("parts.ids").alias("ids")
    )
