"""Toxicity by class-conditional Kneser-Ney bigram models with a shared backoff.

Two models, one of toxic and one of ordinary text, each interpolate discounted bigrams with
discounted continuation counts of their class, and those with the spelling of the word: discounted
letter sequences of the class over letter pairs that both classes share. A word too rare to be known
in a class so costs what its spelling costs, and about the same in both unless its letters tell.

A text's score compares the two log-likelihoods, normalised by length: the mean difference per word,
and what words exceed the text's own median word by, over the root of the word count (which is how
noise in a sum grows). The median is what the language and style of the text alone account for. A
logistic curve over the two is fitted on texts that the models had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm import texts
from sieverank.session import cut

SAMPLE_DOCS = 8_000
DISCOUNT = 2.0
THRESHOLD = 0.7
MARGIN, REACH = 2.0, 8.0


def word_ids(words: pa.Array) -> np.ndarray:
    """A 64-bit id per word; equal words are hashed once."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known.view(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else known.view(np.int64)


def training_rows(labels: DataFrame, learned, sample_docs: int) -> DataFrame:
    """(doc_id, label, fold, weight): up to ``sample_docs`` ids per class, by the hash of the id.

    ``weight`` gives the classes the shares they have among all rows that may be learned from.
    """
    marked = labels.filter(learned).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    marked = cut(marked.filter("doc_id is not null and label in (0, 1)"), "labels")
    all_rows = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    ordered = [marked.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for c in (0, 1)]
    found = cut(ordered[0].union(ordered[1]), "sample")
    taken = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    weight = {c: all_rows[c] / taken[c] for c in taken}
    share = F.when(F.col("label") == 1, weight.get(1, 1.0)).otherwise(weight.get(0, 1.0))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    return found.select("doc_id", "label", fold.alias("fold"), share.alias("weight"))


def pair_counts(sample: DataFrame) -> DataFrame:
    """(label, fold, prev, word, n) over the words of the sampled texts; prev is 0 at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text"):
            words, starts = texts.split_words(block.column("text"))
            ids = word_ids(words)
            before = np.concatenate([[0], ids[:-1]]).astype(np.int64) if len(ids) else ids
            before[starts[:-1][np.diff(starts) > 0]] = 0
            group = block.column("label").to_numpy() * 2 + block.column("fold").to_numpy()
            rows = np.stack([np.repeat(group, np.diff(starts)).astype(np.int64), before, ids])
            order = np.lexsort(rows)
            rows = rows[:, order]
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, rows.shape[1]))
            kept = rows[:, heads]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (kept[0] // 2, kept[0] % 2, kept[1], kept[2], counts.astype(np.int64))],
                ["label", "fold", "prev", "word", "n"],
            )

    rows = sample.mapInArrow(run, "label long, fold long, prev long, word long, n long")
    return rows.groupBy("label", "fold", "prev", "word").agg(F.sum("n").alias("n"))


ORDERS = (5, 3, 2)
CLASS_ORDERS = (5, 3)
LETTER_DISCOUNT = 1.0


def letter_keys(words: list[str]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The word each letter (or end of word) belongs to and, per order, keys of its context and of both.

    Words start after four start marks, so contexts know the start of a word.
    """
    flat = np.frombuffer("".join(f"\x02\x02\x02\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words)) + 5
    inside = flat != 2
    owner = np.repeat(np.arange(len(words)), lengths)[inside]
    found = {}
    for order in ORDERS:
        context = np.full(len(flat), order, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for back in range(order - 1, 0, -1):
            shifted = np.concatenate([np.zeros(back, np.uint64), flat[:-back].astype(np.uint64)]) if len(flat) else context
            context = (context ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(29)
        whole = (context ^ (flat.astype(np.uint64) + np.uint64(1) << np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        whole ^= whole >> np.uint64(31)
        found[order] = (context[inside].view(np.int64), whole[inside].view(np.int64))
    return owner, found


def letter_counts(types: DataFrame) -> DataFrame:
    """(part, context, whole, o, t): how many distinct words of a class have the letters, per order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "word", 1 << 20):
            toxic = block.column("label").to_numpy() == 1
            owner, found = letter_keys(block.column("word").to_pylist())
            for order, (context, whole) in found.items():
                keys, first, at = np.unique(whole, return_index=True, return_inverse=True)
                o = np.bincount(at, ~toxic[owner], len(keys)).astype(np.int64)
                t = np.bincount(at, toxic[owner], len(keys)).astype(np.int64)
                part = np.full(len(keys), order, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, context[first], keys, o, t)], ["part", "context", "whole", "o", "t"])

    rows = types.mapInArrow(run, "part long, context long, whole long, o long, t long")
    return rows.groupBy("part", "context", "whole").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


@dataclass
class Spelling:
    """Letter models of both classes: per order the kept sequences and contexts, sorted by key."""

    sequences: dict[int, tuple[Index, np.ndarray]]
    contexts: dict[int, tuple[Index, np.ndarray]]

    def probabilities(self, words: list[str]) -> np.ndarray:
        """(words, 2): the probability of each word's letters in the ordinary and the toxic class."""
        if not words:
            return np.ones((0, 2))
        owner, found = letter_keys(words)
        lower = np.full((len(owner), 2), 1e-4)
        for order in reversed(ORDERS):
            context, whole = found[order]
            at, has = self.contexts[order][0].find(context)
            lower[has] *= self.contexts[order][1][at[has]]
            here = np.flatnonzero(has)  # a kept sequence has a kept context
            at, has = self.sequences[order][0].find(whole[here])
            lower[here[has]] += self.sequences[order][1][at[has]]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        return np.exp(np.maximum(np.add.reduceat(np.log(lower), heads, axis=0), -600.0))


def build_spelling(types: DataFrame, discount: float = LETTER_DISCOUNT) -> Spelling:
    """From (label, word), distinct. What a discounted count reaches goes to the driver."""
    counts = cut(letter_counts(types), "letters")
    shared = ~F.col("part").isin(*CLASS_ORDERS)
    both = F.col("o") + F.col("t")
    counts = counts.select("part", "context", "whole", F.when(shared, both).otherwise(F.col("o")).alias("o"), F.when(shared, both).otherwise(F.col("t")).alias("t"))
    totals = counts.groupBy("part", "context").agg(
        F.sum("o").alias("o"), F.sum("t").alias("t"),
        F.sum(F.least("o", F.lit(discount))).alias("ro"), F.sum(F.least("t", F.lit(discount))).alias("rt"),
    )
    reached = (F.col("o") > discount) | (F.col("t") > discount)
    kept, seen = _columns(counts.filter(reached), "whole"), _columns(totals.filter(reached), "context")
    sequences, contexts = {}, {}
    for order in ORDERS:
        mine, here = seen["part"] == order, kept["part"] == order
        total = np.stack([seen["o"][mine], seen["t"][mine]], axis=1).astype(float)
        left = np.stack([seen["ro"][mine], seen["rt"][mine]], axis=1).astype(float)
        contexts[order] = Index(seen["context"][mine]), np.where(total > 0, left / np.maximum(total, 1.0), 1.0)
        place, _ = contexts[order][0].find(kept["context"][here])
        mass = np.maximum(np.stack([kept["o"][here], kept["t"][here]], axis=1) - discount, 0.0)
        sequences[order] = Index(kept["whole"][here]), mass / np.maximum(total[place], 1.0) if len(total) else mass
    return Spelling(sequences, contexts)


@dataclass
class Models:
    """Both models as sorted arrays; column 0 is ordinary, 1 is toxic."""

    words: Index  # ids with a continuation count above the discount in either class
    word_mass: np.ndarray  # (words, 2) discounted continuation probability
    spelling: Spelling
    word_backoff: np.ndarray  # (2,)
    contexts: Index  # ids seen as first word of a kept bigram or with a backoff of their own
    context_backoff: np.ndarray  # (contexts, 2)
    pairs: Index  # keys of kept bigrams
    pair_mass: np.ndarray  # (pairs, 2)

    def differences(self, words: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sum over its words of log toxic minus log ordinary probability, and the excess.

        A word counts ``REACH`` at most. The excess sums by how much words lie more than ``MARGIN``
        above zero and above the text's median word.
        """
        if not len(words):
            return np.zeros(len(starts) - 1), np.zeros(len(starts) - 1)
        coded = words.dictionary_encode()
        ids = word_ids(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        place, known = self.words.find(ids)
        # A word that both classes know well does without its spelling, which would change nothing.
        rare = ~known if not len(self.words.keys) else ~(known & (self.word_mass[place].min(axis=1) > 0))
        lower = np.zeros((len(ids), 2))
        lower[rare] = self.word_backoff * self.spelling.probabilities(coded.dictionary.filter(pa.array(rare)).to_pylist())
        lower[known] += self.word_mass[place[known]]
        context, has_context = self.contexts.find(ids)
        weight = np.ones((len(ids), 2))
        weight[has_context] = self.context_backoff[context[has_context]]
        begin, has_begin = self.contexts.find(np.zeros(1, np.int64))
        at_start = self.context_backoff[begin[0]] if has_begin[0] else np.ones(2)
        before = np.concatenate([[0], at[:-1]])
        first = np.zeros(len(at), bool)
        first[starts[:-1][np.diff(starts) > 0]] = True
        ratio = np.log(lower[:, 1] / lower[:, 0])[at]
        step = np.log(weight[:, 1] / weight[:, 0])[before]
        step[first] = np.log(at_start[1] / at_start[0])
        total = ratio + step
        # A pair's second word need not be known: one that follows the same word always has no mass of its own.
        spots = np.flatnonzero(has_context[before] | first)
        prev_ids = np.where(first[spots], 0, ids[before[spots]])
        pair, hit = self.pairs.find(pair_key(prev_ids, ids[at[spots]]))
        spots, pair, start_here = spots[hit], pair[hit], first[spots[hit]]
        back = np.where(start_here[:, None], at_start, weight[before[spots]]) * lower[at[spots]]
        full = self.pair_mass[pair] + back
        total[spots] = np.log(full[:, 1] / full[:, 0])
        total = np.clip(total, -REACH, REACH)
        middle = [max(0.0, np.median(total[a:b])) if b > a else 0.0 for a, b in zip(starts[:-1], starts[1:], strict=True)]
        above = np.maximum(total - np.repeat(middle, np.diff(starts)) - MARGIN, 0.0)
        sums, excess = (np.concatenate([[0.0], np.cumsum(values)]) for values in (total, above))
        return sums[starts[1:]] - sums[starts[:-1]], excess[starts[1:]] - excess[starts[:-1]]


class Index:
    """Places of 64-bit keys that are spread evenly: looked up by their leading bits."""

    def __init__(self, keys: np.ndarray):
        """``keys`` distinct, sorted as signed integers, as the arrays that go with them are."""
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.keys, self.shift = keys, np.int64(64 - bits)
        self.half = 1 << (bits - 1)
        slots = (keys >> self.shift) + self.half
        self.heads = np.searchsorted(slots, np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key and whether it is there; place 0 for those that are not."""
        place, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slots = (keys >> self.shift) + self.half
        at, end = self.heads[slots], self.heads[slots + 1]
        left = np.flatnonzero(at < end)
        at, end, keys = at[left], end[left], keys[left]
        while len(left):
            same = self.keys[at] == keys
            place[left[same]], known[left[same]] = at[same], True
            more = ~same & (at + 1 < end)
            left, at, end, keys = left[more], at[more] + 1, end[more], keys[more]
        return place, known


def pair_key(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = prev.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.astype(np.int64).view(np.uint64)
    return (mixed * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def build(pairs: DataFrame, types: DataFrame, discount: float = DISCOUNT) -> Models:
    """Both models from pair counts and word types; only what a discounted count reaches is brought to the driver.

    Its size is bounded by the sample that was counted.
    """
    toxic, ordinary = F.col("label") == 1, F.col("label") == 0
    both = cut(
        pairs.groupBy("prev", "word").agg(
            F.sum(F.when(ordinary, F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("t")
        ),
        "pairs",
    )
    cont = both.groupBy("word").agg(
        F.count_if(F.col("o") > 0).alias("o"), F.count_if(F.col("t") > 0).alias("t")
    )
    cont = cut(cont, "continuations")
    sums = cont.agg(
        F.sum("o"), F.sum("t"), F.sum(F.least("o", F.lit(discount))), F.sum(F.least("t", F.lit(discount))),
    ).first()
    total = np.maximum(np.array([sums[0] or 0, sums[1] or 0], float), 1.0)
    rest = np.array([sums[2] or 0.0, sums[3] or 0.0])
    word_backoff = np.where(rest > 0, rest / total, 1.0)
    reached = _columns(cont.filter((F.col("o") > discount) | (F.col("t") > discount)), "word")
    word_counts = np.stack([reached["o"], reached["t"]], axis=1).astype(float)
    contexts = _columns(
        both.groupBy("prev").agg(
            F.sum("o").alias("o"), F.sum("t").alias("t"),
            F.sum(F.least("o", F.lit(discount))).alias("ro"), F.sum(F.least("t", F.lit(discount))).alias("rt"),
        ).filter((F.col("o") > discount) | (F.col("t") > discount)),
        "prev",
    )
    seen = np.stack([contexts["o"], contexts["t"]], axis=1).astype(float)
    left = np.stack([contexts["ro"], contexts["rt"]], axis=1).astype(float)
    kept = _columns(both.filter((F.col("o") > discount) | (F.col("t") > discount)), "prev")
    keys = pair_key(kept["prev"], kept["word"])
    order = np.argsort(keys)
    known = Index(contexts["prev"])
    place, _ = known.find(kept["prev"][order])
    mass = np.maximum(np.stack([kept["o"], kept["t"]], axis=1)[order] - discount, 0.0)
    return Models(
        words=Index(reached["word"]),
        word_mass=np.maximum(word_counts - discount, 0.0) / total,
        spelling=build_spelling(types.select("label", "word").distinct()),
        word_backoff=word_backoff,
        contexts=known,
        context_backoff=np.where(seen > 0, left / np.maximum(seen, 1.0), 1.0),
        pairs=Index(keys[order]),
        pair_mass=mass / np.maximum(seen[place], 1.0) if len(seen) else mass,
    )


def word_types(sample: DataFrame) -> DataFrame:
    """(label, fold, word), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text"):
            words, starts = texts.split_words(block.column("text"))
            group = np.repeat(block.column("label").to_numpy() * 2 + block.column("fold").to_numpy(), np.diff(starts))
            for value in np.unique(group):
                mine = words.filter(pa.array(group == value)).unique()
                parts = [np.full(len(mine), v, np.int64) for v in (value // 2, value % 2)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, parts), mine], ["label", "fold", "word"])

    return sample.mapInArrow(run, "label long, fold long, word string").distinct()


def _columns(rows: DataFrame, key: str) -> dict[str, np.ndarray]:
    found = rows.toArrow()
    columns = {name: found.column(name).to_numpy() for name in found.column_names}
    order = np.argsort(columns[key])
    return {name: values[order] for name, values in columns.items()}


def features(total: np.ndarray, excess: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1, the mean difference per word, and the excess over the root of the word count."""
    n = np.maximum(count, 1.0)
    return np.stack([np.ones_like(total), total / n, excess / np.sqrt(n)], axis=1)


def fit_curve(rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    at = np.zeros(rows.shape[1])
    ridge = np.diag([1e-3, 1e-3, 1e-3])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ at, -35, 35)))
        slope = rows.T @ (weight * (label - p)) - ridge @ at
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge
        move = np.linalg.solve(curve, slope)
        at = at + move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return at


def _scored(rows: DataFrame, models: Models, keep: list[str], schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text"):
            words, starts = texts.split_words(block.column("text"))
            total, excess = shared.value.differences(words, starts)
            columns = [block.column(name) for name in keep]
            columns += [pa.array(total), pa.array(excess), pa.array(np.diff(starts).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "difference", "excess", "n_words"])

    return rows.mapInArrow(run, f"{schema}, difference double, excess double, n_words long")


def score(
    documents: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, sample_docs: int = SAMPLE_DOCS,
    discount: float = DISCOUNT, threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, difference, excess, n_words) for every row, over whole texts.

    Labels are learned from rows whose crc32(doc_id as text) modulo ``modulus`` is not ``held``; of
    these up to ``sample_docs`` of each class, those with the smallest hash of the id, which bounds
    the models. Where a doc_id has several labels, toxic wins; null labels are ignored; without
    both classes every score is the share of the class there is, or 0. Null and empty texts get the
    score of a difference of zero. Repeated rows are scored repeatedly. Other columns take no part.
    """
    spark = documents.sparkSession
    texts.prepare(spark)
    bare = texts.with_text(documents)
    learned = texts.remainder("doc_id", modulus) != held
    rows = training_rows(labels, learned, sample_docs)
    sample = cut(bare.join(F.broadcast(rows), "doc_id"), "sample_texts")
    pairs, types = cut(pair_counts(sample), "pair_counts"), cut(word_types(sample), "types")
    trial = []
    for fold in (0, 1):
        part = _scored(
            sample.filter(F.col("fold") == fold),
            build(pairs.filter(F.col("fold") != fold), types.filter(F.col("fold") != fold), discount),
            ["label", "weight"], "label int, weight double",
        ).toArrow()
        trial.append(np.stack([part.column(c).to_numpy().astype(float) for c in ("label", "weight", "difference", "excess", "n_words")]))
    label, weight, total, excess, count = np.concatenate(trial, axis=1)
    if 0 < label.sum() < len(label):
        curve = fit_curve(features(total, excess, count), label, weight)
    else:
        curve = np.array([35.0 if label.sum() else -35.0, 0.0, 0.0])
    models = build(pairs, types, discount)
    found = _scored(bare, models, ["doc_id"], "doc_id long")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    value = F.lit(float(curve[0])) + float(curve[1]) * F.col("difference") / n + float(curve[2]) * F.col("excess") / F.sqrt(n)
    return found.select(
        "doc_id", (texts.remainder("doc_id", modulus) == held).alias("held_out"), (1 / (1 + F.exp(-value))).alias("score"),
        "difference", "excess", "n_words",
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
