"""Quality by a weak-label model: heuristic labellers, expectation-maximisation, a hashed scorer.

Labellers look at a text's surface and vote good, bad or not at all. How often they vote together is
all that expectation-maximisation needs to estimate how often each is right, without a label. The
posteriors it gives are the targets of a linear scorer over hashed features of the text, which so
also judges texts on which the labellers say little.
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

SAMPLE_DOCS = 12_000
FEATURE_BITS = 16
THRESHOLD = 0.5
FALSE_ALARM = 0.002
LABELLERS = ("marks", "capitals", "repeats", "variety", "lone", "length", "letters", "sentences")


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """Per text: words, and the shares the labellers look at."""
    texts_full = texts.mapped(column, lower=False)
    words, starts = texts.split_words(column, lower=False)
    n = np.diff(starts)
    safe = np.maximum(n, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[starts[1:]] - sums[starts[:-1]]

    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    kinds = coded.dictionary

    def flag(mask) -> np.ndarray:
        return mask.to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, bool)

    letters = pc.utf8_length(pc.replace_substring_regex(kinds, r"[^\pL\pN]", ""))
    sizes = pc.utf8_length(kinds)
    odd = pc.match_substring_regex(kinds, r"[#$%&*@^~<>{}\\|!]{2}|^[^\pL\pN]+$")
    has_capital, has_small = pc.match_substring_regex(kinds, r"\p{Lu}{2}"), pc.match_substring_regex(kinds, r"\p{Ll}")
    same = np.zeros(len(at), bool)
    same[1:] = at[1:] == at[:-1]
    same[starts[:-1][n > 0]] = False
    owner = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique(owner * (len(kinds) + 1) + at) // (len(kinds) + 1), minlength=len(n)) if len(at) else np.zeros(len(n))
    return {
        "words": n,
        "marks": per_text(flag(odd)) / safe,
        "capitals": per_text(flag(pc.and_(has_capital, pc.invert(has_small)))) / safe,
        "repeats": per_text(same) / safe,
        "variety": distinct / safe ** 0.8,
        "lone": per_text(flag(pc.less(letters, 1))) / safe,
        "letters": per_text(letters.to_numpy(zero_copy_only=False)[at].astype(float) if len(at) else np.zeros(0))
        / np.maximum(per_text(sizes.to_numpy(zero_copy_only=False)[at].astype(float) if len(at) else np.zeros(0)), 1),
        "stops": per_text(flag(pc.match_substring_regex(kinds, r"\pL[.?!]$"))) / safe,
        "chars": pc.utf8_length(texts_full).to_numpy(zero_copy_only=False),
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers): 1 good, 0 bad, -1 no vote."""
    n = found["words"]
    some = n >= 5

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good & some, 1, -1))

    columns = {
        "marks": vote(found["marks"] > 0.2, found["marks"] < 0.05),
        "capitals": vote((found["capitals"] > 0.5) & some, found["capitals"] < 0.2),
        "repeats": vote(found["repeats"] > 0.3, found["repeats"] < 0.1),
        "variety": vote((found["variety"] < 0.35) & (n >= 50), (found["variety"] > 0.6) & (n >= 50)),
        "lone": vote(found["lone"] > 0.2, found["lone"] < 0.05),
        "length": vote(n < 1, n >= 20),
        "letters": vote((found["letters"] < 0.7) & (found["chars"] >= 20), found["letters"] > 0.85),
        "sentences": vote((found["stops"] < 0.01) & (n >= 60), (found["stops"] > 0.02) & (n >= 20)),
    }
    return np.stack([columns[name] for name in LABELLERS], axis=1).astype(np.int8)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Prior of good, and per class and labeller the chance that a vote is bad: (2, labellers).

    Labellers are made to be precise: a good text is called bad with a chance of ``FALSE_ALARM`` at
    most. That keeps apart what is good and what is bad, however many kinds of junk there are that
    only one labeller sees. A labeller that does not vote says nothing. Counts are smoothed by one.
    """
    prior = 0.9
    chance = np.stack([np.full(patterns.shape[1], 0.4), np.full(patterns.shape[1], FALSE_ALARM / 2)])
    for _ in range(rounds):
        good = posterior(patterns, prior, chance)
        before = chance
        prior = float(np.clip((good * counts).sum() / max(counts.sum(), 1), 0.05, 0.99))
        found = []
        for share in (1 - good, good):
            bad, fine = (((patterns == v) * (counts * share)[:, None]).sum(0) for v in (0, 1))
            found.append((bad + 1.0) / (bad + fine + 2.0))
        chance = np.stack([np.maximum(found[0], 0.05), np.minimum(found[1], FALSE_ALARM)])
        if np.abs(chance - before).max() < 1e-9:
            break
    return prior, chance


def posterior(patterns: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    """The probability of good, per row of votes."""
    alarm, fine = np.log(chance[1]) - np.log(chance[0]), np.log(1 - chance[1]) - np.log(1 - chance[0])
    odds = np.log(prior) - np.log(1 - prior) + (patterns == 0) @ alarm + (patterns == 1) @ fine
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -60, 60)))


def hashed(column: pa.Array, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, slots and values of a sparse matrix: each text's words' shapes and ends, unit length.

    A word's shape maps letters to a or A, digits to 0 and keeps other characters, with runs
    shortened; shapes and whether a word repeats the one before tell junk in any language.
    """
    words, starts = texts.split_words(column, lower=False)
    n = np.diff(starts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    shape = coded.dictionary
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\pL+", "a"), (r"\pN+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, mark)
    kinds = shape.dictionary_encode()
    slot = np.fromiter((xxhash.xxh64_intdigest(s) & ((1 << bits) - 1) for s in kinds.dictionary.to_pylist()), np.int64, len(kinds.dictionary))
    slot = slot[kinds.indices.to_numpy(zero_copy_only=False)][at]
    again = np.zeros(len(at), bool)
    again[1:] = at[1:] == at[:-1]
    again[starts[:-1][n > 0]] = False
    slot = np.where(again, (slot * 31 + 7) & ((1 << bits) - 1), slot)
    keys, counts = np.unique(np.repeat(np.arange(len(n)), n) << bits | slot, return_counts=True)
    rows, slots = keys >> bits, keys & ((1 << bits) - 1)
    values = np.sqrt(counts / n[rows])
    return rows, slots, values


def fit(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, target: np.ndarray, size: int) -> np.ndarray:
    """Weights of a logistic scorer (the last one is the constant), by full-batch adaptive steps."""
    weights, mass = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(150):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(rows, weights[slots] * values, len(target)) + weights[-1], -35, 35)))
        slope = (p - target) / max(len(target), 1)
        grad = np.append(np.bincount(slots, slope[rows] * values, size), slope.sum()) + 1e-6 * weights
        mass += grad * grad
        weights -= 0.5 * grad / np.sqrt(mass)
    return weights


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = FEATURE_BITS) -> tuple:
    """Prior, chances and weights. Vote patterns are counted over all rows.

    The linear scorer is fitted on up to ``sample_docs`` rows, those with the smallest hash of id
    and text; that bounds what the driver holds.
    """
    texts.prepare(documents.sparkSession)
    patterns = _voted(texts.with_text(documents)).groupBy("votes").count().toArrow()  # 3 ** labellers rows at most
    table = np.array([[ord(c) - ord("1") for c in v] for v in patterns.column("votes").to_pylist()], np.int8).reshape(-1, len(LABELLERS))
    prior, chance = estimate(table, patterns.column("count").to_numpy().astype(float))
    return prior, chance, _fitted(documents, prior, chance, sample_docs, bits)


def judged(column: pa.Array, model: tuple, bits: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Per text: the label model's chance of good, the scorer's, whether it stays, and the votes."""
    prior, chance, weights = model
    found = votes(measures(column))
    weak = posterior(found, prior, chance)
    rows, slots, values = hashed(column, bits)
    line = np.bincount(rows, weights[slots] * values, len(column)) + weights[-1]
    value = 1.0 / (1.0 + np.exp(-np.clip(line, -35, 35)))
    blank = found[:, LABELLERS.index("length")] == 0
    return weak, value, ((weak + value) / 2 >= threshold) & ~blank, found


def score(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = FEATURE_BITS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, weak, score, keep, votes) for every row, over whole texts.

    ``weak`` is the label model's probability of good, ``score`` the linear scorer's, ``keep`` whether
    their mean reaches the threshold, ``votes`` a digit per labeller in the order of ``LABELLERS``: 0 none,
    1 bad, 2 good. Null and blank texts are not kept. Repeated rows are scored repeatedly; a null
    doc_id stays null; an empty table gives no rows; other columns take no part.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, sample_docs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 20):
            weak, value, keep, found = judged(block.column("text"), shared.value, bits, threshold)
            columns = [block.column("doc_id"), pa.array(weak), pa.array(value), pa.array(keep), _marks(found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "weak", "score", "keep", "votes"])

    return texts.with_text(documents).mapInArrow(run, "doc_id long, weak double, score double, keep boolean, votes string")


def keep_good(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = FEATURE_BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``score`` keeps, with all their columns; judged where they stand, without a join."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, sample_docs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 20):
            yield block.filter(pa.array(judged(block.column("text"), shared.value, bits, threshold)[2]))

    return documents.mapInArrow(run, documents.schema)


def _voted(bare: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([_marks(votes(measures(block.column("text"))))], ["votes"])

    return bare.mapInArrow(run, "votes string")


def _marks(found: np.ndarray) -> pa.Array:
    """Votes as text: 0 none, 1 bad, 2 good."""
    return pa.array(["".join(row) for row in (found + 1).astype("U1")], pa.string())


def _fitted(documents: DataFrame, prior: float, chance: np.ndarray, sample_docs: int, bits: int) -> np.ndarray:
    bare = texts.with_text(documents)
    marked = bare.withColumn("order", F.xxhash64("doc_id", "text"))
    last = marked.select("order").orderBy("order").limit(sample_docs).agg(F.max("order")).first()[0]
    if last is None:
        return np.zeros((1 << bits) + 1)
    # Rows with one hash are repeats of each other: one of them is enough.
    sample = marked.filter(F.col("order") <= F.lit(last)).dropDuplicates(["order"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in texts.blocks(batches, "text", 1 << 20):
            good = posterior(votes(measures(block.column("text"))), prior, chance)
            rows, slots, values = hashed(block.column("text"), bits)
            ends = np.searchsorted(rows, np.arange(len(good) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (slots, values)]
            yield pa.RecordBatch.from_arrays([pa.array(good), *lists], ["good", "slots", "values"])

    found = sample.mapInArrow(run, "good double, slots array<long>, values array<double>").toArrow()
    counts = pc.list_value_length(found.column("slots")).to_numpy()
    rows = np.repeat(np.arange(len(counts)), counts)
    slots, values = (pc.list_flatten(found.column(c)).to_numpy() for c in ("slots", "values"))
    return fit(rows, slots, values, found.column("good").to_numpy(), 1 << bits)
