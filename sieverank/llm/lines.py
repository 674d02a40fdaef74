"""Line dedup by a deletion-neighbourhood join within one edited word.

Equal lines are collapsed first. Lines within one edit share the first or the last half of their words
less one, so a join on those halves leaves the lines that can have a neighbour at all. These emit every
variant with one word deleted, and themselves, as hashed keys. Two lines that meet on a key with the
same place deleted differ in one word; a line that meets another's variant has one word less. So each
key needs its earliest members only, never pairs, and each line at most one link per key. The edit
distance of linked lines is verified, and a line that has an earlier equal or neighbour goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.session import cut

MIN_WORDS = 5
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _B
    values = (values ^ (values >> np.uint64(29))) * _C
    return values ^ (values >> np.uint64(32))


class Hashes:
    """Sums of mixed (word, place) values, so that any part of a line has its hash by two lookups."""

    def __init__(self, words: pa.Array, starts: np.ndarray):
        coded = words.dictionary_encode()
        digest = xxhash.xxh64_intdigest
        known = np.fromiter((digest(w, 11) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.ids = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else known
        self.starts, self.sizes = starts[:-1], np.diff(starts)
        self.line = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(words)) - self.starts[self.line]

    def sums(self, place: np.ndarray, salt: int) -> np.ndarray:
        """Running sums of the words' values at the given places, from 0."""
        values = _mix(self.ids + (place.astype(np.uint64) + np.uint64(salt)) * _A)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def whole(self, salt: int) -> np.ndarray:
        total = self.sums(self.place, salt)
        return _mix(total[self.starts + self.sizes] - total[self.starts] + self.sizes.astype(np.uint64) * _B)

    def anchors(self) -> np.ndarray:
        """(lines, 4): hashes of the first and last half less one, for the line and for one word less."""
        ahead, behind = self.sums(self.place, 1), self.sums(self.sizes[self.line] - 1 - self.place, 1 << 20)
        ends, found = self.starts + self.sizes, []
        for least in (self.sizes, self.sizes - 1):
            half = np.maximum((least - 1) // 2, 0)
            tag = _mix(least.astype(np.uint64) * _C)
            found.append(_mix(ahead[self.starts + half] - ahead[self.starts] + tag))
            found.append(_mix((behind[ends] - behind[ends - half]) ^ (tag + _A)))
        return np.stack(found, axis=1)

    def variants(self) -> np.ndarray:
        """A hash per word: its line without that word, equal to ``whole`` of a line that reads so."""
        kept, moved = self.sums(self.place, 1), self.sums(self.place - 1, 1)
        begin, end = self.starts[self.line], (self.starts + self.sizes)[self.line]
        at = np.arange(len(self.place))
        sums = (kept[at] - kept[begin]) + (moved[end] - moved[at + 1])
        return _mix(sums + (self.sizes[self.line] - 1).astype(np.uint64) * _B)


def _lines(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines, the text each belongs to, and its number there."""
    lists = pc.split_pattern(pc.fill_null(column, ""), "\n")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return lists.flatten(), owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def line_keys(documents: DataFrame, min_words: int, equal_words: int) -> DataFrame:
    """(doc_id, line, h, g, anchors) of every line of ``equal_words`` words; no anchors under ``min_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 20):
            lines, owner, number = _lines(block.column("text"))
            hashes = Hashes(*texts.split_words(lines))
            long = np.flatnonzero(hashes.sizes >= min(min_words, equal_words))
            near = hashes.sizes[long] >= min_words
            anchors = hashes.anchors()[long[near]].astype(np.uint64).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(near * 4)]).astype(np.int32)
            columns = [block.column("doc_id").take(pa.array(owner[long])), pa.array(number[long].astype(np.int32))]
            columns += [pa.array(hashes.whole(salt)[long].view(np.int64)) for salt in (1, 1 << 40)]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(anchors.ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "h", "g", "anchors"])

    bare = texts.with_text(documents).filter("doc_id is not null")
    return bare.mapInArrow(run, "doc_id long, line int, h long, g long, anchors array<long>")


def _variants(numbered: DataFrame) -> DataFrame:
    """(key, place, at) of the lines in (at, text): place -1 for the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 18):
            hashes = Hashes(*texts.split_words(block.column("text")))
            at = block.column("at").to_numpy()
            keys = np.concatenate([hashes.whole(1), hashes.variants()]).view(np.int64)
            place = np.concatenate([np.full(len(at), -1), hashes.place]).astype(np.int32)
            owner = np.concatenate([at, at[hashes.line]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, place, owner)], ["key", "place", "at"])

    return numbered.select("at", "text").mapInArrow(run, "key long, place int, at long")


def _in_order(lines: DataFrame) -> DataFrame:
    """Adds ``at``: one number per (doc_id, line), in their order, counted part by part."""
    dealt = cut(lines.repartitionByRange("doc_id", "line").withColumn("part", F.spark_partition_id()), "dealt")
    ranked = dealt.withColumn("own", F.dense_rank().over(Window.partitionBy("part").orderBy("doc_id", "line")))
    sizes = ranked.groupBy("part").agg(F.max("own").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranked.join(F.broadcast(before), "part").select((F.col("own") + F.col("before")).alias("at"), "doc_id", "line", "text")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one inserted, deleted or replaced word at most makes the lists equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    tail = 0
    while tail < min(len(a), len(b)) - same and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return max(len(a), len(b)) - same - tail <= 1


def _verified(links: DataFrame) -> DataFrame:
    """The links (at, near) whose texts are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 20):
            words = []
            for name in ("text", "other"):
                flat, starts = texts.split_words(block.column(name))
                flat = flat.to_pylist()
                words.append([flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
            good = [within_one(a, b) for a, b in zip(*words, strict=True)]
            yield block.select(["at", "near"]).filter(pa.array(good, pa.bool_()))

    return links.mapInArrow(run, "at long, near long")


def _texts_of(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line, text) of the lines in ``lines`` (doc_id, line)."""
    wanted = lines.groupBy("doc_id").agg(F.collect_set("line").alias("wanted"))
    texts_of = texts.with_text(documents).join(wanted, "doc_id")
    # One line per number even if rows repeat an id: the smallest text stands for them.
    numbered = texts_of.select("doc_id", F.explode("wanted").alias("line"), F.split("text", "\n").alias("lines"))
    found = numbered.select("doc_id", "line", F.get("lines", F.col("line")).alias("text")).filter("text is not null")
    return found


def repeats(documents: DataFrame, min_words: int = MIN_WORDS, equal_words: int | None = None) -> DataFrame:
    """(doc_id, line, kind, of_doc_id, of_line): every line that an earlier line makes superfluous.

    Lines are parts of the text between line feeds, numbered from 0, and compared as sequences of
    words (A-Z made small); those of fewer than ``min_words`` words have no near lines, and those of fewer
    than ``equal_words`` (``min_words`` if not given) take no part. Earlier means a smaller (doc_id, line). ``kind`` is equal, for all but the earliest of equal lines, which they name, or near, for the
    earliest of equal lines if an earlier line is within one inserted, deleted or replaced word; the
    earliest such line is named, kept or not. Null and empty texts have no lines here; rows without
    doc_id take no part; rows that repeat an id count as one text, at whose line numbers all their
    lines stand. An empty table gives no rows; other columns take no part.
    """
    texts.prepare(documents.sparkSession)
    marked = cut(line_keys(documents, min_words, min_words if equal_words is None else equal_words), "lines")
    at = F.struct("doc_id", "line")
    distinct = cut(marked.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line", "anchors")).alias("first"), F.count("*").alias("n")), "distinct")
    first = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"))
    again = distinct.filter("n > 1").select("h", "g", first.alias("of"))
    equal = marked.join(again, ["h", "g"]).select(at.alias("at"), "of").filter("at > of")
    anchors = distinct.select(first.alias("at"), F.explode("first.anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    chosen = anchors.join(shared, "anchor").select("at.doc_id", "at.line").distinct()
    # Line texts travel once; rows that repeat an id give a place several texts, each with its variants.
    lines = cut(_in_order(_texts_of(documents, chosen).distinct()), "chosen")
    variants = cut(_variants(lines), "variants")
    mins = cut(variants.groupBy("key", "place").agg(F.min("at").alias("least"), F.max("at").alias("most")), "keys")
    replaced = variants.join(mins.filter("least < most and place >= 0"), ["key", "place"]).select("at", F.col("least").alias("near"))
    full = mins.filter("place < 0").select("key", F.col("least").alias("whole"), F.col("most").alias("last_whole"))
    less = mins.filter("place >= 0").groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    both = cut(full.join(less, "key").filter("whole < most or least < last_whole"), "both")
    met = variants.join(both, "key")
    crossed = met.select("at", F.when(F.col("place") < 0, F.col("least")).otherwise(F.col("whole")).alias("near"))
    links = replaced.union(crossed).filter("near < at").distinct()
    named = lines.select("at", "text")
    texted = links.join(named, "at").join(named.select(F.col("at").alias("near"), F.col("text").alias("other")), "near")
    near = _verified(texted).groupBy("at").agg(F.min("near").alias("near"))
    places = lines.select("at", F.struct("doc_id", "line").alias("spot")).distinct()
    near = near.join(places, "at").select(F.col("spot").alias("at"), "near")
    near = near.join(places.select(F.col("at").alias("near"), F.col("spot").alias("of")), "near").select("at", "of")
    found = equal.withColumn("kind", F.lit("equal")).unionByName(near.withColumn("kind", F.lit("near")))
    return found.select("at.doc_id", "at.line", "kind", F.col("of.doc_id").alias("of_doc_id"), F.col("of.line").alias("of_line"))


def drop_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without those lines, all columns kept; ``n_chars``, if there is one, counts anew.

    A text that loses lines and has no word left goes; all others stay, rows without doc_id as they are. Lines
    are named by ids, so where different texts share an id none of these loses a line.
    """
    found = repeats(documents, min_words)
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    shared = hashed.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least != most").select("doc_id")
    gone = found.join(shared, "doc_id", "left_anti").groupBy(F.col("doc_id").alias("__sieverank_of")).agg(F.collect_set("line").alias("__sieverank_gone"))
    joined = documents.join(gone, documents["doc_id"] == gone["__sieverank_of"], "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__sieverank_gone", i)), "\n")
    touched = F.col("__sieverank_gone").isNotNull()
    text = F.when(touched, rest).otherwise(F.col("text"))
    kept = joined.withColumn("text", text).filter(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(touched, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.drop("__sieverank_of", "__sieverank_gone")
