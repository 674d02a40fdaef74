"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

The first tokenizer (byte-level BPE, library tokenizers) reads a space and the text; the second
(sentencepiece, with byte fallback) reads the text and puts that space before it itself. Both give spans: the
first character offsets, the second byte spans of its proto. These are coarse cuts: tokens that are parts of
one character share its span. Between two coarse cuts the lengths of the tokens' own bytes tell where each
ends. Byte offsets where tokens of both end cut a text into groups.

Both tokenizers always cut before a single space that follows something other than a space and precedes
no white space, and between ASCII letters and other ASCII signs: the first one's pattern ends a match there, and
no piece of the second goes across (``Tokenizers`` refuses a vocabulary with such a piece). So texts are taken
apart there, and a worker encodes a unit once as long as it remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.llm.units import coded, gathered, raw, split_units, spread
from sieverank.operators.joins import join_hot
from sieverank.session import cut

BLOCK_BYTES = 4 << 20
MAX_KNOWN = 200_000
ENCODED_AT_ONCE = 5_000
DIGESTED_AT_ONCE = 200_000
SPACE = "▁"
#: Pairs of ids are one number: first * PAIR + second.
PAIR = 1 << 32


#: What no piece of the second tokenizer may hold: a line end, a space behind other characters, a letter beside a sign.
_ACROSS = re.compile(rf"\n|[^{SPACE}]{SPACE}|[A-Za-z][!-@\[-`{{-~]|[!-@\[-`{{-~][A-Za-z]")


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for their own byte; the other bytes, in order, for the
    characters from 256 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def _table(entries: list[bytes]) -> pa.Array:
    return pa.array(entries, pa.binary())


class Tokenizers:
    """The two tokenizers of a worker, with the bytes of every entry."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        stands = _byte_of_character()
        names = self.a.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            known = all(c in stands for c in name)
            entries[i] = bytes(stands[c] for c in name) if known else name.encode()
        self.a_bytes = _table(entries)
        self.b = SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        usual = [p for i, p in enumerate(pieces) if not (self.b_is_byte[i] or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(_ACROSS.search(p) for p in usual) or len(self.b.encode("\n")) != 2:
            raise ValueError("a piece goes across a cut, so texts cannot be taken apart")
        self.b_bytes = _table(
            [bytes([int(p[3:5], 16)]) if is_byte else p.replace(SPACE, " ").encode() for p, is_byte in zip(pieces, self.b_is_byte, strict=True)]
        )

    def first(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Ids, begins and ends (in characters of the unit), and how many tokens each unit has."""
        ids, spans, sizes = [], [], []
        for found in self.a.encode_batch(units, add_special_tokens=False):
            ids.extend(found.ids)
            spans.extend(found.offsets)
            sizes.append(len(found.ids))
        both = np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)
        return np.array(ids, np.int64), both[:, 0], both[:, 1], np.array(sizes, np.int64)

    def second(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """The same of the second, in bytes of the unit.

        It puts a space before what it reads. A unit that does not start with one is read behind a line end, and
        the tokens of that space and line end are left out.
        """
        ids, begins, ends, sizes = [], [], [], []
        own = [u[0] == " " for u in units]
        found = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, own, strict=True)], return_type="proto", num_threads=1)
        for one, starts_own in zip(found, own, strict=True):
            parts, shift = one.pieces, 1 if starts_own else -1
            if not starts_own:
                parts = parts[2:]
            sizes.append(len(parts))
            for part in parts:
                ids.append(part.id)
                begins.append(part.begin + shift)
                ends.append(part.end + shift)
        return tuple(np.array(x, np.int64) for x in (ids, begins, ends, sizes))


@lru_cache(maxsize=2)
def _tokenizers(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


def refined(coarse: np.ndarray, is_cut: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where tokens end: at the coarse cut, or where their own bytes end that follow the last coarse cut."""
    own = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(is_cut, np.arange(len(own)), -1))
    shift = np.where(last >= 0, coarse[last] - own[last], 0)
    return own + shift


def _same_bytes(entries: pa.Array, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Per unit, whether the bytes of its tokens are its own."""
    joined, at = raw(entries.take(pa.array(ids)))
    bounds = at[np.concatenate([[0], np.cumsum(sizes)])]
    same = np.diff(bounds) == np.diff(places)
    own, theirs = spread(np.diff(places), np.flatnonzero(same)), spread(np.diff(bounds), np.flatnonzero(same))
    differ = np.concatenate([[0], np.cumsum(data[own[0]] != joined[theirs[0]])])
    same[same] = differ[own[1][1:]] == differ[own[1][:-1]]
    return same


@dataclass
class Aligned:
    """Distinct units, aligned. Units whose tokens are not their bytes are not ``ok`` and have no token."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    ends: np.ndarray  # of all groups, unit by unit, in bytes of the unit
    sizes: np.ndarray  # bytes of the unit
    pairs: np.ndarray  # of all groups: the ids that end it
    a_lists: pa.ListArray  # of all groups
    b_lists: pa.ListArray

    def words(self) -> pa.Array:
        """Each unit's groups as text."""
        both = [pc.binary_join(x.cast(pa.list_(pa.string())), ",") for x in (self.a_lists, self.b_lists)]
        groups = pc.binary_join_element_wise(*both, "|")
        bounds = pa.array(np.concatenate([[0], np.cumsum(self.n_groups)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(bounds, groups), ";")


def align_units(units: pa.Array, tools: Tokenizers) -> Aligned:
    """The groups of every unit."""
    found = []
    for start in range(0, len(units), ENCODED_AT_ONCE):
        some = units[start : start + ENCODED_AT_ONCE].to_pylist()
        found.append((*tools.first(some), *tools.second(some)))
    a, a_begin, a_end, a_size, b, b_begin, b_end, b_size = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 8))
    data, places = raw(units)
    ok = _same_bytes(tools.a_bytes, a, a_size, data, places) & _same_bytes(tools.b_bytes, b, b_size, data, places)
    a_unit, b_unit = np.repeat(np.arange(len(units)), a_size), np.repeat(np.arange(len(units)), b_size)
    a_kept, b_kept = ok[a_unit], ok[b_unit]
    a, a_begin, a_end, a_unit = (x[a_kept] for x in (a, a_begin, a_end, a_unit))
    b, b_begin, b_end, b_unit = (x[b_kept] for x in (b, b_begin, b_end, b_unit))

    # The first: a character offset is the place where that character starts.
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    character = np.searchsorted(starts, places[:-1])
    a_coarse = starts[character[a_unit] + a_end]
    a_last = np.append(a_unit[1:] != a_unit[:-1], True) if len(a_unit) else np.zeros(0, bool)
    a_cut = a_last | (np.append(a_begin[1:], 0) >= a_end)
    a_ends = _ends(tools.a_bytes, a, a_unit, a_coarse, a_cut, places, ok)
    # The second: byte tokens but the last of a character have an empty span.
    b_coarse = places[:-1][b_unit] + b_end
    b_cut = ~(tools.b_is_byte[b] & (b_begin == b_end))
    b_ends = _ends(tools.b_bytes, b, b_unit, b_coarse, b_cut, places, ok)

    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_at, b_at = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    of = np.searchsorted(places, cuts) - 1  # the unit a cut lies in; its end belongs to it
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, at + 1), pa.int32()), pa.array(x)) for x, at in ((a, a_at), (b, b_at))]
    n = len(units)
    return Aligned(
        ok, np.where(ok, a_size, 0), np.where(ok, b_size, 0), np.bincount(of, minlength=n), cuts - places[:-1][of],
        np.diff(places), a[a_at] * PAIR + b[b_at], *lists,
    )


def _ends(entries, ids, unit, coarse, is_cut, places, ok) -> np.ndarray:
    """Ends of tokens as places in the bytes of all units; the units that are not ok have no token but bytes."""
    lengths = pc.binary_length(entries.take(pa.array(ids))).to_numpy(zero_copy_only=False).astype(np.int64)
    missing = np.concatenate([[0], np.cumsum(np.where(ok, 0, np.diff(places)))])[unit]
    return refined(coarse - missing, is_cut, lengths) + missing


def _digests(words: pa.Array, codes: np.ndarray, starts: np.ndarray, good: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups; '' for texts without tokens."""
    found = [""] * len(good)
    first = 0
    while first < len(good):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + DIGESTED_AT_ONCE, side="right")) - 1)
        if starts[last] - starts[first] > DIGESTED_AT_ONCE:  # one very long text
            whole = hashlib.sha256()
            for at in range(starts[first], starts[last], DIGESTED_AT_ONCE):
                part = words.take(pa.array(codes[at : min(at + DIGESTED_AT_ONCE, starts[last])]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), ";")[0]
                whole.update((b";" if at > starts[first] else b"") + joined.as_buffer().to_pybytes())
            if good[first]:
                found[first] = whole.hexdigest()
        else:
            part = words.take(pa.array(codes[starts[first] : starts[last]]))
            lists = pa.ListArray.from_arrays(pa.array(starts[first : last + 1] - starts[first], pa.int32()), part)
            for i, joined in zip(range(first, last), pc.binary_join(lists, ";"), strict=True):
                if good[i]:
                    found[i] = hashlib.sha256(joined.as_buffer()).hexdigest()
        first = last
    return found


@dataclass
class Known:
    """What a worker keeps of units: whether they are ok, their counts, the pairs that end their groups, and these as text."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    pairs: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, aligned: Aligned) -> Known:
        return cls(aligned.ok, aligned.n_a, aligned.n_b, aligned.n_groups, aligned.pairs, aligned.words())

    def __add__(self, other: Known) -> Known:
        arrays = [np.concatenate([getattr(x, name) for x in (self, other)]) for name in ("ok", "n_a", "n_b", "n_groups", "pairs")]
        return Known(*arrays, pa.concat_arrays([self.words, other.words]))

    def take(self, at: np.ndarray) -> Known:
        entries, _ = spread(self.n_groups, at)
        return Known(self.ok[at], self.n_a[at], self.n_b[at], self.n_groups[at], self.pairs[entries], self.words.take(pa.array(at)))


class Memory:
    """The units a worker has met, until they are ``MAX_KNOWN``."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.known: Known | None = None

    def look_up(self, units: pa.Array, tools: Tokenizers) -> Known:
        names = units.to_pylist()
        if len(self.number) > MAX_KNOWN:
            self.number, self.known = {}, None
        new = [u for u in names if u not in self.number]
        if new or self.known is None:
            found = Known.of(align_units(pa.array(new, pa.string()), tools))
            self.known = found if self.known is None else self.known + found
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        return self.known.take(np.fromiter(map(self.number.__getitem__, names), np.int64, len(names)))


@lru_cache(maxsize=2)
def _memory(first: str, second: str) -> Memory:
    return Memory()


def _good(ok: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a text has tokens: all of its units are ok, and it has units."""
    wrong = np.concatenate([[0], np.cumsum(~ok[codes])])[starts]
    return (np.diff(wrong) == 0) & (np.diff(starts) > 0)


_BLOCK = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, places array<int>, pairs array<long>, times array<long>"


def _blocks(documents: DataFrame, first: str, second: str) -> DataFrame:
    """Per text its counts and digest, and its links as places in the pairs of its block; per block its pairs and their counts.

    Rows of blocks have ``pairs``, rows of texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tokenizers(first, second)
        number = TaskContext.get().partitionId() << 32
        for block in gathered(batches, "text", BLOCK_BYTES):
            units, starts = split_units(block.column("text").combine_chunks())
            distinct, codes = coded(units)
            del units
            aligned = _memory(first, second).look_up(distinct, tools)
            good = _good(aligned.ok, codes, starts)
            codes, sizes = codes[np.repeat(good, np.diff(starts))], np.where(good, np.diff(starts), 0)
            starts = np.concatenate([[0], np.cumsum(sizes)])

            def total(of: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(of[codes])])[starts])

            entries, at = spread(aligned.n_groups, codes)
            used, place = np.unique(aligned.pairs, return_inverse=True)
            links = place[entries]
            times = np.bincount(links, minlength=len(used))
            kept = np.flatnonzero(times)
            renumbered = np.cumsum(times > 0) - 1
            links, n = renumbered[links], len(good)
            yield _rows(
                block=np.full(n, number), doc_id=block.column("doc_id").combine_chunks(), n_a=total(aligned.n_a), n_b=total(aligned.n_b),
                n_groups=total(aligned.n_groups), groups_sha256=_digests(aligned.words, codes, starts, good),
                places=pa.ListArray.from_arrays(pa.array(at[starts], pa.int32()), pa.array(links, pa.int32())),
            )
            if len(kept):
                ends = pa.array([0, len(kept)], pa.int32())
                yield _rows(
                    block=[number], pairs=pa.ListArray.from_arrays(ends, pa.array(used[kept], pa.int64())),
                    times=pa.ListArray.from_arrays(ends, pa.array(times[kept], pa.int64())),
                )
            number += 1

    return texts.with_text(documents).mapInArrow(run, _BLOCK)


_TYPES = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _rows(**columns) -> pa.RecordBatch:
    """A batch of the block schema; columns not given are null."""
    fields = [pa.field(name, _TYPES[kind]) for name, kind in (f.split() for f in _BLOCK.split(", "))]
    n = len(columns["block"])
    values = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in fields]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], schema=pa.schema(fields))


def _counted(pairs: DataFrame) -> DataFrame:
    """(pair, n, blocks): how many links hold a pair, and in how many blocks it occurs."""
    return pairs.groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("blocks"))


def _of_blocks(stored: DataFrame) -> DataFrame:
    """(block, place, pair, times) of all blocks."""
    rows = stored.filter(F.col("pairs").isNotNull())
    both = F.arrays_zip("pairs", "times")
    return rows.select("block", F.posexplode(both).alias("place", "of")).select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.times").alias("times"))


def pair_counts(documents: DataFrame, first: str, second: str) -> DataFrame:
    """(a_id, b_id, n): how many links of all texts hold the two tokens linked."""
    texts.prepare(documents.sparkSession)
    counts = _counted(_of_blocks(cut(_blocks(documents, first, second), "alignment")))
    return counts.select(F.floor(F.col("pair") / PAIR).alias("a_id"), F.pmod("pair", F.lit(PAIR)).alias("b_id"), "n")


def groups(documents: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, group, start, end, a_ids, b_ids): the aligned spans, in bytes of a space and the text.

    Texts without tokens have no row.
    """
    texts.prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tokenizers(first, second)
        for block in gathered(batches, "text", BLOCK_BYTES):
            units, starts = split_units(block.column("text").combine_chunks())
            distinct, codes = coded(units)
            aligned = align_units(distinct, tools)
            good = _good(aligned.ok, codes, starts)
            base = np.cumsum(aligned.sizes[codes]) - aligned.sizes[codes]
            base = base - np.repeat(base[starts[:-1][np.diff(starts) > 0]], np.diff(starts)[np.diff(starts) > 0])
            document = np.repeat(np.arange(len(good)), np.diff(starts))
            unit = np.flatnonzero(good[document])
            for at in range(0, len(unit), DIGESTED_AT_ONCE):
                some = unit[at : at + DIGESTED_AT_ONCE]
                entries, _ = spread(aligned.n_groups, codes[some])
                of = np.repeat(some, aligned.n_groups[codes[some]])
                rows = pa.array(entries)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": block.column("doc_id").combine_chunks().take(pa.array(document[of])), "end": base[of] + aligned.ends[entries],
                    "a_ids": aligned.a_lists.take(rows), "b_ids": aligned.b_lists.take(rows), "text": document[of], "unit": of,
                })

    return texts.with_text(documents).mapInArrow(_numbered(run), "doc_id long, group long, start long, end long, a_ids array<long>, b_ids array<long>")


def _numbered(run):
    """Adds to rows in order of texts the number of the group and its start, the end of the one before."""

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, group, end = -1, 0, 0
        for found in run(batches):
            of, ends = found.column("text").to_numpy(), found.column("end").to_numpy()
            new = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
            start = np.append(0, ends[:-1]) if len(ends) else ends
            start = np.where(new, 0, start)
            begins = np.flatnonzero(new)
            order = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
            if len(of) and of[0] == text and ends[0] > end:  # the text before goes on
                same = int(begins[1]) if len(begins) > 1 else len(of)
                order[:same] += group
                start[0] = end
            if len(of):
                text, group, end = int(of[-1]), int(order[-1]) + 1, int(ends[-1])
            yield pa.RecordBatch.from_pydict({
                "doc_id": found.column("doc_id"), "group": order, "start": start, "end": ends, "a_ids": found.column("a_ids"), "b_ids": found.column("b_ids"),
            })

    return more


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block with what the counts of its pairs say."""
    n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    place = right.column("place").to_numpy()
    n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
    lists = left.column("places").combine_chunks()
    links, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
    at = np.concatenate([[0], np.cumsum(sizes)])
    count_sum, n_best = (np.diff(np.concatenate([[0], np.cumsum(x[links])])[at]) for x in (n, best))
    found = left.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
    for name, values in (("n_links", sizes), ("n_best", n_best), ("count_sum", count_sum)):
        found = found.append_column(name, pa.array(values, pa.int64()))
    return found


def align(documents: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum): one row per row of documents.

    Counts are those of all texts. Texts that are null or empty, or whose tokens do not give back a space and
    the text, have no tokens: zeros and ''. Equal rows count each; a null doc_id is like any other; an empty
    table gives no rows; other columns take no part. The files named have to be readable by the executors.
    """
    texts.prepare(documents.sparkSession)
    stored = cut(_blocks(documents, first, second), "alignment")
    asked = _of_blocks(stored)
    counts = cut(_counted(asked), "pair-counts")
    token = F.pmod("pair", F.lit(PAIR))
    highest = counts.groupBy(token.alias("b_id")).agg(F.max("n").alias("highest"))  # one row per entry of the vocabulary at most
    known = counts.withColumn("b_id", token).join(F.broadcast(highest), "b_id")
    known = known.select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"), "blocks")
    pulled = join_hot(asked.select("pair", "block", "place"), known, on="pair", copies="blocks", spread_by="block")
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    of_texts = stored.filter(F.col("pairs").isNull()).drop("pairs", "times")
    pulled = pulled.select(F.col("block").alias("of_block"), "place", "n", "best")
    return of_texts.groupBy("block").cogroup(pulled.groupBy("of_block")).applyInArrow(_scored, schema)
