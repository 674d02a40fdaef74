"""Language-model scores by logistic context mixing, over the bits of texts.

A text is its words, A-Z made small, and one end mark. A token is written in two steps. First, which of the most
frequent training tokens it is, or none of them: bits predicted from the words before (``following``). Then, if
it is none of them, its spelling in bytes with a closing space, in the bits of a Huffman code over bytes: each
predicted by the last bytes of the token, none to four, hashed, and all its bytes so far, each from counts of
the training texts. In both steps a set of weights, chosen by how much the longest contexts have seen, combines
the predictions in the logistic domain, and an adaptive map refines the result. Weights and map are learned
online, from predictions that leave out the occurrence they predict. A spelling costs the same wherever it
stands, so each distinct token is spelled once; what the words before tell is predicted for every occurrence.

Spelled words of a group (a language, say) go together. Which group a text is of is not told to the model: the
probability of its spelled tokens is the mixture over groups, where a group gives a token its probability times
the share of the group among the token's occurrences, normalised.

Texts are encoded in chunks of bounded size; a chunk later gets the counts and costs of exactly the
tokens it holds. No vocabulary is broadcast: what goes to every task is the frequent tokens and the hashed tables,
whose sizes are set by ``following.FREQUENT`` and ``BITS``. The vocabulary is dealt by the first bytes of its tokens, as
many as make the groups small, so that all tokens that share longer beginnings meet in one task, where those are
counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.llm import bits, following, texts, units
from sieverank.llm.bits import GATES, LEVELS, Code, Model, Sums, stretched, stretched_without, summed_tables, table_rows
from sieverank.session import cut, shared_folder

CHUNK_BYTES = 64 << 20
END = "\n"
#: Table sizes as powers of two, for the contexts of 0 to 4 bytes before.
BITS = (8, 16, 18, 20, 20)
ORDERS = len(BITS) + 1
#: Beginnings of so many bytes or more are counted where the vocabulary lies, as far as their groups are small enough;
#: the last hashed context knows shorter ones.
HEAD_BYTES = len(BITS)
#: Tokens that share a beginning are a group of up to so many bytes.
GROUP_BYTES = 1 << 20
GROUPS = 8
SLOTS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
BATCH_WORDS = 4_096
STEP_BITS = 16_384
STEP_WORDS = 1 << 14
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Spelled:
    """The bytes of a batch of tokens and the contexts before each.

    Tokens are distinct, come in order and begin alike: a byte behind the same beginning in a run of tokens is the same
    byte in the same contexts, and is held once (a place). ``spans`` tells from which length on a token's beginnings are
    counted exactly; it is the same for tokens that share a beginning of that length.
    """

    def __init__(self, words: list[bytes], spans: np.ndarray, code: Code):
        self.code = code
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = b" ".join([*words, b""])
        if b"\n" in words:  # the end alone has no space behind it
            sizes[nth := words.index(b"\n")] = 1
            behind = int(sizes[:nth].sum()) + 1
            data = data[:behind] + data[behind + 1 :]
        every = np.frombuffer(data, np.uint8)
        self.heads = np.cumsum(sizes) - sizes
        self.sizes = sizes
        far = np.arange(len(data)) - np.repeat(self.heads, sizes)
        # Where a token first differs from the one before, and all behind that, is a place of its own.
        back = np.repeat(np.append([0], sizes[:-1])[: len(sizes)], sizes)
        apart = far >= back
        shared = np.flatnonzero(~apart)
        apart[shared] = every[shared] != every[shared - back[shared]]
        runs = np.cumsum(apart)
        own = runs > np.repeat((runs - apart)[self.heads], sizes)
        # Tokens that go on alike follow each other among those that are as long.
        ranked = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        mine = own[ranked]
        self.place = np.empty(len(data), np.int64)
        self.place[ranked] = np.cumsum(mine) - 1
        first = ranked[mine]
        far = far[first]
        self.bytes = every[first].astype(np.int64)
        symbols = every.astype(np.uint64) + np.uint64(1)
        self.contexts = [np.zeros(len(first), np.uint64)]
        hashed = np.zeros(len(first), np.uint64)
        for back in range(1, len(BITS)):
            before = np.where(far >= back, symbols.take(np.maximum(first - back, 0)), np.uint64(0))
            hashed = (hashed + before + np.uint64(back << 16)) * _A
            hashed ^= hashed >> np.uint64(29)
            self.contexts.append(hashed)
        # Where a whole beginning is counted exactly: the place it ends at, or -1 where no other place follows it.
        self.deep = far >= np.repeat(spans, sizes)[first]
        parent = np.where(far > 0, self.place.take(np.maximum(first - 1, 0)) + 1, 0)
        self.beginning = np.where(self.deep & (np.bincount(parent, minlength=1)[parent] > 1), parent, -1)

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """How often each place occurs, if tokens occur so often."""
        return np.bincount(self.place, np.repeat(counts, self.sizes).astype(np.float64), len(self.bytes))

    def bits(self, weight: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Per place in the code and up to ``STEP_BITS`` bits: places, nodes, bits, and exact counts.

        ``weight`` is how often each place occurs in training; without it there are no counts. These (zeros and ones
        seen after the same beginning) are -1 where the hashed contexts know the beginning.
        """
        length = self.code.length[self.bytes]
        at = np.flatnonzero(length)
        for nth in range(int(length.max(initial=0))):
            at = at[length[at] > nth]
            byte = self.bytes[at]
            node, bit = self.code.node[nth][byte], self.code.bit[nth][byte]
            exact = None if weight is None else self.exact(at, node, bit, weight[at])
            for start in range(0, len(at), STEP_BITS):
                part = slice(start, start + STEP_BITS)
                yield at[part], node[part], bit[part], None if exact is None else exact[part]

    def exact(self, at: np.ndarray, node: np.ndarray, bit: np.ndarray, often: np.ndarray) -> np.ndarray:
        deep = self.deep[at]
        # A column for each side, so that each lies together.
        exact = np.empty((2, len(at)), np.float32).T
        for side in range(2):
            exact[:, side] = np.where(deep, often * (bit == side), -1)
        beginning = self.beginning[at]
        far = np.flatnonzero(beginning >= 0)
        if len(far):
            _, same = np.unique(beginning[far] << 8 | node[far], return_inverse=True)
            total = np.bincount(same, often[far])
            ones = np.bincount(same, often[far] * bit[far])
            exact[far, 0], exact[far, 1] = (total - ones)[same], ones[same]
        return exact

    def slots(self, at: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
        """The slots of bits in the joint table, order by order."""
        salt = (node.astype(np.uint64) + np.uint64(1)) * _B
        yield node
        for order in range(1, len(BITS)):
            mixed = self.contexts[order].take(at)
            mixed ^= salt
            mixed *= _A
            mixed >>= np.uint64(64 - BITS[order])
            slot = mixed.view(np.int64)
            slot += SLOTS[order]
            yield slot


def _gate(longest: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The weight set: by what the whole beginning and the last four bytes have seen, and if one side only."""
    zeros, ones = longest[:, 0], longest[:, 1]
    most, some = np.log2(1 + (zeros + ones)), np.log2(1 + seen)
    sure = (np.minimum(zeros, ones) == 0).astype(np.int64)
    return np.minimum(most, LEVELS - 1).astype(np.int64) * 4 + np.minimum(some / 4, 1).astype(np.int64) * 2 + sure


def own_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``inputs_without`` needs of the joint table: predictions (slots, 2), by the bit, and the counts of the last order."""
    return stretched_without(table), table[SLOTS[-2] :]


def inputs_without(own: tuple[np.ndarray, np.ndarray], spelled: Spelled, at: np.ndarray, node: np.ndarray, bit: np.ndarray, exact: np.ndarray):
    """(orders, bits) predictions from counts less the occurrence they predict, and the gates."""
    return _inputs(own, spelled, at, node, exact, bit)


def inputs_of(ready: tuple[np.ndarray, np.ndarray], spelled: Spelled, at: np.ndarray, node: np.ndarray, exact: np.ndarray):
    """The same from all counts, with the hashed contexts' predictions and their last counts ready."""
    return _inputs(ready, spelled, at, node, exact, None)


def _inputs(tables: tuple[np.ndarray, np.ndarray], spelled: Spelled, at: np.ndarray, node: np.ndarray, exact: np.ndarray, without: np.ndarray | None):
    lines, last = tables
    inputs = np.empty((ORDERS, len(at)), np.float32)
    for order, slot in enumerate(spelled.slots(at, node)):
        inputs[order] = lines.take(slot if without is None else slot * 2 + without)
    known = exact[:, 0] < 0
    pair, longest = last.take(slot - SLOTS[ORDERS - 2], axis=0).T, np.empty((2, len(at)), np.float32)
    seen = np.zeros(len(at), np.float32)
    for side in range(2):
        count, whole = pair[side], exact[:, side]
        if without is not None:
            one = (without == side).astype(np.float32)
            count, whole = np.maximum(count - one, 0), np.maximum(whole - one, 0)
        seen += count
        longest[side] = np.where(known, count, whole)
    inputs[-1] = stretched(longest.T)
    return inputs, _gate(longest.T, seen)


def counted(words: list[bytes], counts: np.ndarray, spans: np.ndarray, table: np.ndarray, code: Code) -> None:
    """Adds each token's bits, as often as it occurs, to the joint table (slots, 2)."""
    spelled = Spelled(words, spans, code)
    weight, flat = spelled.weights(counts), table.reshape(-1)
    for at, node, bit, _ in spelled.bits(None):
        often = weight[at]
        for slot in spelled.slots(at, node):
            np.add.at(flat, slot * 2 + bit, often)


def gathered(words: list[bytes], counts: np.ndarray, spans: np.ndarray, table: np.ndarray, code: Code, sums: Sums) -> None:
    """``gathered_from`` a table of counts."""
    gathered_from(own_of(table), words, counts, spans, code, sums)


def gathered_from(own: tuple, words: list[bytes], counts: np.ndarray, spans: np.ndarray, code: Code, sums: Sums) -> None:
    """Adds each token's bits, as often as it occurs, to what weights and map are made of."""
    spelled = Spelled(words, spans, code)
    weight = spelled.weights(counts)
    for at, node, bit, exact in spelled.bits(weight):
        inputs, gate = inputs_without(own, spelled, at, node, bit, exact)
        sums.add(inputs, gate, bit, weight[at])


def costs_of(words: list[bytes], counts: np.ndarray, spans: np.ndarray, ready: tuple, model: Model, code: Code) -> np.ndarray:
    """log10 of each token's probability; ``ready`` is the joint table's predictions and the counts of its last order."""
    spelled = Spelled(words, spans, code)
    total = np.zeros(len(spelled.bytes))
    for at, node, bit, exact in spelled.bits(spelled.weights(counts)):
        inputs, gate = inputs_of(ready, spelled, at, node, exact)
        total[at] += model.cost(inputs, gate, bit)
    return np.add.reduceat(total[spelled.place], spelled.heads) if len(words) else np.zeros(0)


_GROUPED = ", ".join(f"n{g} long" for g in range(GROUPS))


def number_bytes(size: int) -> int:
    """How many bytes a number below ``size`` takes: three if that is enough."""
    return 3 if size <= 1 << 24 else 4


def packed_numbers(numbers: np.ndarray, size: int) -> np.ndarray:
    """Numbers below ``size`` as rows of bytes."""
    width = number_bytes(size)
    return np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]


def unpacked_numbers(data: bytes, size: int) -> np.ndarray:
    width = number_bytes(size)
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u4")[:, 0]


def encoded(bare: DataFrame) -> str:
    """Writes texts as numbers of their chunk's tokens, and the tokens of each chunk; gives the folder.

    kind=0: chunk, doc_id, held_out, tokens (packed numbers). kind=1: chunk, number, word, and how often the
    word occurs in training texts of each group. Texts are dropped block by block; a chunk holds numbers
    and its words only.
    """
    schema = "kind int, chunk long, doc_id long, held_out boolean, tokens binary, number int, word string, " + _GROUPED
    names = [part.split()[0] for part in schema.split(", ")]

    def whole(chunk: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array([words for words, *_ in parts]).unify_dictionaries()
        dictionary = coded.chunk(0).dictionary
        end, size = len(dictionary), len(dictionary) + 1
        cells, ends = [], np.zeros(GROUPS, np.int64)
        no = lambda n, kind: pa.nulls(n, kind)
        for words, (_, starts, ids, held_out, group) in zip(coded.chunks, parts, strict=True):
            numbers = words.indices.to_numpy(zero_copy_only=False)
            trained = ~held_out.to_numpy(zero_copy_only=False)
            cells.append((np.repeat(group, np.diff(starts)) * size + numbers)[np.repeat(trained, np.diff(starts))].astype(np.int32 if size < 1 << 27 else np.int64))
            ends += np.bincount(group[trained], minlength=GROUPS)
            rows, packed = len(ids), packed_numbers(np.append(numbers, end), size)
            tail = packed[-1].tobytes()
            tokens = pa.array([packed[a:b].tobytes() + tail for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            columns = [pa.array(np.zeros(rows, np.int32)), pa.array(np.full(rows, chunk)), ids, held_out, tokens,
                       no(rows, pa.int32()), no(rows, pa.string()), *[no(rows, pa.int64())] * GROUPS]
            yield pa.RecordBatch.from_arrays(columns, names)
        counts = np.bincount(np.concatenate(cells), minlength=size * GROUPS).reshape(GROUPS, size)
        counts[:, end] = ends
        word = pa.concat_arrays([dictionary, pa.array([END])])
        columns = [pa.array(np.ones(size, np.int32)), pa.array(np.full(size, chunk)), no(size, pa.int64()), no(size, pa.bool_()),
                   no(size, pa.binary()), pa.array(np.arange(size, dtype=np.int32)), word,
                   *(pa.array(c) for c in counts)]
        yield from pa.Table.from_arrays(columns, names).to_batches(65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for block in texts.blocks(batches, "text"):
            words, starts = texts.split_words(block.column("text"))
            held_out, group = pa.concat_arrays([block.column("held_out")]), block.column("group").to_numpy()
            parts.append((words.dictionary_encode(), starts, pa.concat_arrays([block.column("doc_id")]), held_out, group))
            size += block.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield from whole(chunk, parts)
                chunk, parts, size = chunk + 1, [], 0
        if parts:
            yield from whole(chunk, parts)

    path = shared_folder(bare.sparkSession, "encoded")
    bare.mapInArrow(run, schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def _changes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows, without the first, whose bytes (``size`` of the data from ``at``) are not those of the row before."""
    differs = size[1:] != size[:-1]
    for nth in range(int(size.max(initial=0))):
        open_ = np.flatnonzero(~differs & (size[1:] > nth))
        if not len(open_):
            break
        differs[open_] = data[at[open_ + 1] + nth] != data[at[open_] + nth]
    return np.flatnonzero(differs) + 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[bytes], np.ndarray, np.ndarray]]:
    """Runs of whole groups, of ``BATCH_WORDS`` tokens or more, from a partition sorted by token: rows, tokens, counts, spans."""

    def ready(parts: list[pa.Table]) -> tuple[pa.Table, list[bytes], np.ndarray, np.ndarray]:
        rows = pa.concat_tables(parts).combine_chunks()
        words = rows.column("word").cast(pa.binary()).to_pylist()
        return rows, words, rows.column("c").to_numpy(), rows.column("span").to_numpy()

    waiting, size, last = [], 0, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not batch.num_rows:
            continue
        data, places = units.raw(batch.column("word"))
        size_of = np.minimum(np.diff(places), batch.column("span").to_numpy())
        first, end = (data[places[i] : places[i] + size_of[i]].tobytes() for i in (0, -2 + len(places)))
        cuts = _changes(data, places[:-1], size_of).tolist()
        if waiting and last != first:
            cuts.insert(0, 0)
        start, last = 0, end
        for at in cuts:
            if size + at - start >= BATCH_WORDS:
                waiting.append(rows.slice(start, at - start))
                yield ready(waiting)
                waiting, size, start = [], 0, at
        if rows.num_rows > start:
            waiting.append(rows.slice(start))
            size += rows.num_rows - start
    if waiting:
        yield ready(waiting)


def head(length: int | str) -> Column:
    return F.expr(f"substring(cast(word as binary), 1, {length})")


def with_spans(vocabulary: DataFrame) -> DataFrame:
    """Adds ``span``: the length of the beginning that a token's group shares.

    Groups of more than ``GROUP_BYTES`` are parted by beginnings twice as long, until none is left. Only the beginnings of
    groups that are too large are broadcast, less than one for every ``GROUP_BYTES`` of the vocabulary.
    """
    vocabulary, length = vocabulary.withColumn("span", F.lit(HEAD_BYTES)), HEAD_BYTES
    while True:
        sizes = vocabulary.filter(F.col("span") == length).groupBy(head(length).alias("_head")).agg(F.sum(F.octet_length("word") + 1).alias("_size"), F.count("*").alias("_n"))
        large = cut(sizes.filter((F.col("_size") > GROUP_BYTES) & (F.col("_n") > 1)).select("_head", F.lit(2 * length).alias("_span")), "heads")
        if large.isEmpty():
            return vocabulary
        found = vocabulary.withColumn("_head", head(length)).join(F.broadcast(large), "_head", "left")
        vocabulary, length = found.withColumn("span", F.coalesce(F.col("_span"), F.col("span"))).drop("_head", "_span"), 2 * length


def byte_counts(vocabulary: DataFrame) -> np.ndarray:
    """How often each byte occurs in the spelled training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            words = batch.column("word")
            size = pc.binary_length(words).to_numpy(zero_copy_only=False)
            data = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
            c = batch.column("c").to_numpy().astype(np.float64)
            total += np.bincount(data, np.repeat(c, size), 256)
            total[32] += c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    rows = vocabulary.select("word", "c").mapInArrow(run, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(256)
    for row in rows:
        found[row["byte"]] = row["n"]
    return found


def hashed_counts(vocabulary: DataFrame, code: Code) -> np.ndarray:
    """The joint table (slots, 2), summed over all training tokens; its size is fixed by ``BITS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SLOTS[-1], 2))
        for _, words, counts, spans in _batches(batches):
            counted(words, counts, spans, table, code)
        yield from table_rows(table)

    return summed_tables(vocabulary, run, SLOTS[-1])


def grouped(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with all tokens of a group in one task, in order."""
    return vocabulary.repartition(head("span")).sortWithinPartitions("word")


def learned(vocabulary: DataFrame, own, code: Code) -> Model:
    """Weights and map, from all training tokens and the broadcast ``own_of`` their table; a group of tokens is in one round."""

    def gather(batches: Iterator[pa.RecordBatch], sums: Sums) -> None:
        for _, words, counts, spans in _batches(batches):
            gathered_from(own.value, words, counts, spans, code, sums)

    return bits.learned(vocabulary, F.pmod(F.xxhash64(head("span")), F.lit(bits.SHARES)), gather, GATES, ORDERS, grouped)


def counted_words(words: DataFrame) -> DataFrame:
    """The vocabulary: word, its counts per group and in all."""
    sums = words.groupBy("word").agg(*(F.sum(f"n{g}").alias(f"n{g}") for g in range(GROUPS)))
    total = sum((F.col(f"n{g}") for g in range(1, GROUPS)), F.col("n0"))
    return sums.withColumn("c", total)


def with_groups(vocabulary: DataFrame, shares: np.ndarray) -> DataFrame:
    """(word, c, groups): the groups' shares of a word as eight numbers of 1 to 255 in 64 bits."""
    packed = F.lit(0).cast("long")
    for g in range(GROUPS):
        share = (F.col(f"n{g}") + float(shares[g])) / (F.col("c") + 1)
        packed = packed.bitwiseOR(F.shiftleft(F.greatest(F.lit(1), F.round(share * 255)).cast("long"), 8 * g))
    return vocabulary.select("word", "c", "often", packed.alias("groups"))


def unpacked(groups: np.ndarray) -> np.ndarray:
    """(words, groups) shares, summing to 1."""
    parts = (groups.view(np.uint64)[:, None] >> (np.arange(GROUPS, dtype=np.uint64) * np.uint64(8))) & np.uint64(255)
    return parts / parts.sum(axis=1, keepdims=True)


def score(documents: DataFrame, modulus: int = 7, held: int = 2, group: str | None = "lang") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Learned from the rows whose crc32(doc_id as text) modulo ``modulus`` is not ``held``. ``score`` is the
    log10 probability of the text's tokens and end, ``base_score`` that of single tokens with one added to
    each count; ``bits_per_byte`` spreads ``score`` over the spelled bytes. ``group`` names a column by whose
    most frequent values, up to ``GROUPS`` less one and all others as one, training texts are grouped; a text's
    own value takes no part in its score. A null text is empty and has an end only; a null doc_id is
    learned from; repeated rows count repeatedly; with no training row the counts are zero; an empty
    table gives no rows; other columns take no part.
    """
    spark = documents.sparkSession
    texts.prepare(spark)
    value = F.coalesce(F.col(group).cast("string"), F.lit("")) if group in documents.columns else F.lit("")
    out = texts.remainder("doc_id", modulus) == held
    top = documents.filter(~out).groupBy(value.alias("g")).count().orderBy(F.desc("count"), "g").limit(GROUPS - 1).collect()
    number = F.lit(GROUPS - 1)
    for g, row in enumerate(top):
        number = F.when(value == row["g"], g).otherwise(number)
    bare = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), number.alias("group"), F.col("text").cast("string").alias("text")
    )
    path = encoded(bare)
    schema = "chunk long, doc_id long, held_out boolean, tokens binary, number int, word string, " + _GROUPED
    rows = spark.read.schema(schema + ", kind int").parquet(path)
    words = rows.filter("kind = 1")
    counts = cut(counted_words(words), "counts")
    sums = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)
    # The tokens with a number, and what is needed to tell the others' groups apart.
    short = counts.filter((F.col("c") > 1) & (F.octet_length("word") <= following.FREQUENT_BYTES))
    top = short.orderBy(F.desc("c"), "word").limit(following.FREQUENT).select("word", "c").collect()
    frequent = pa.array([row["word"] for row in top], pa.string())
    often = F.broadcast(spark.createDataFrame([(row["word"], True) for row in top], "word string, often boolean"))
    marked = counts.join(often, "word", "left").withColumn("often", F.col("often").isNotNull())
    sums = marked.filter("not often").agg(*(F.sum(f"n{g}") for g in range(GROUPS))).first()
    shares = np.array([(sums[g] or 0) + 1.0 for g in range(GROUPS)])
    shares /= shares.sum()
    # Which frequent token follows, from the words before.
    number = Code(np.array([row["c"] for row in top] + [total - sum(row["c"] for row in top)]))
    training = bare.filter("not held_out").select("doc_id", "text")
    context = following.counts_of(training, frequent, number)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(bits.SHARES))
    # What learning and scoring need of the tables is worked out once, not by every task.
    own = spark.sparkContext.broadcast(following.Own(context))
    follows = spark.sparkContext.broadcast(following.Ready(context, following.learned(training, share, own, frequent, number)))
    own.unpersist()  # every executor keeps a copy on its disk
    del context
    # How the others are spelled.
    vocabulary = cut(with_spans(with_groups(marked, shares)), "vocabulary")
    learnt = vocabulary.filter("c > 0 and not often").select("word", "c", "span")
    code = Code(byte_counts(learnt))
    table = hashed_counts(grouped(learnt), code)
    own = spark.sparkContext.broadcast(own_of(table))
    model = learned(learnt, own, code)
    ready = spark.sparkContext.broadcast((stretched(table), table[SLOTS[-2] :]))
    own.unpersist()
    del table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, spelled, c, spans in _batches(batches):
            symbol = following.symbols(pa.concat_arrays(part.column("word").chunks), frequent)
            rare = symbol >= len(frequent)
            cost = np.zeros(len(spelled), np.float32)
            cost[rare] = costs_of([w for w, r in zip(spelled, rare, strict=True) if r], c[rare], spans[rare], ready.value, model, code)
            names = ["word", "c", "cost", "groups", "symbol"]
            found = pa.table([part.column("word"), part.column("c"), pa.array(cost), part.column("groups"), pa.array(symbol.astype(np.int32))], names=names)
            yield from found.combine_chunks().to_batches(65_536)

    costs = cut(grouped(vocabulary).mapInArrow(run, "word string, c long, cost float, groups long, symbol int"), "costs")
    ready.unpersist()
    # What a group's shares add up to, weighted by probability; tokens never seen have the shares of all.
    part = [F.shiftrightunsigned("groups", 8 * g).bitwiseAND(255) for g in range(GROUPS)]
    whole = sum(part[1:], part[0])
    known = costs.filter((F.col("c") > 0) & (F.col("symbol") >= len(frequent)))
    mass = known.agg(*(F.sum(F.pow(F.lit(10.0), F.col("cost").cast("double")) * (p / whole - float(shares[g]))) for g, p in enumerate(part))).first()
    scale = np.log10(np.maximum(shares + np.array([m or 0.0 for m in mass]), 1e-9))
    size = F.when(F.col("word") == END, 1).otherwise(F.octet_length("word") + 1).cast("int")
    pulled = words.select("chunk", "number", "word", size.alias("bytes")).join(costs, "word").select(
        F.col("chunk").alias("of_chunk"), "number", "bytes", "c", "cost", "groups", "symbol"
    )
    return rows.filter("kind = 0").select("chunk", "doc_id", "held_out", "tokens").groupBy("chunk").cogroup(pulled.groupBy("of_chunk")).applyInArrow(
        lambda left, right: _summed(left, right, total, distinct, shares, scale, follows.value, len(frequent), number),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )


def _summed(left: pa.Table, right: pa.Table, total: int, distinct: int, shares: np.ndarray, scale: np.ndarray, ready: following.Ready, often: int, number: Code) -> pa.Table:
    """The scores of a chunk's texts, from what is known of its tokens."""
    order = np.argsort(right.column("number").to_numpy())
    c, size, cost, groups, symbol = (right.column(name).to_numpy()[order] for name in ("c", "bytes", "cost", "groups", "symbol"))
    base = np.log10((c + 1.0) / (total + distinct + 1.0))
    apart = np.empty((len(c), GROUPS))
    for at in range(0, len(c), STEP_WORDS):
        part = slice(at, at + STEP_WORDS)
        known = np.where((c[part] > 0)[:, None], unpacked(np.ascontiguousarray(groups[part])), shares)
        apart[part] = np.log10(known) - scale
    apart[symbol < often] = 0
    symbol = symbol.astype(np.int64)
    packed = left.column("tokens")
    n_tokens = pc.binary_length(packed).to_numpy().astype(np.int64) // number_bytes(len(c))
    ends = np.cumsum(n_tokens)
    columns = [np.zeros(len(packed)) for _ in range(4)]
    start = 0
    while start < len(packed):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + following.STEP_TOKENS, side="right")))
        # Only the texts of a step are unpacked.
        at, starts = unpacked_numbers(b"".join(packed[start:stop].to_pylist()), len(c)), ends[start:stop] - n_tokens[start:stop] - before
        each = np.log10(shares) + np.add.reduceat(apart.take(at, axis=0), starts, axis=0)
        most = each.max(axis=1)
        mixed = most + np.log10((10.0 ** (each - most[:, None])).sum(axis=1))
        token = cost[at] + ready.cost(following.Sequences(symbol[at], starts, number))
        found = np.add.reduceat(c[at] > 0, starts, dtype=np.int64), np.add.reduceat(base[at], starts), mixed + np.add.reduceat(token, starts), np.add.reduceat(size[at], starts, dtype=np.int64)
        for column, values in zip(columns, found, strict=True):
            column[start:stop] = values
        start = stop
    n_known, base_score, score, spelled = columns
    values = [left.column("doc_id"), left.column("held_out"), pa.array(n_tokens), pa.array(n_known.astype(np.int64)),
              pa.array(np.full(len(packed), total)), pa.array(base_score), pa.array(score), pa.array(score / -np.log10(2.0) / np.maximum(spelled, 1))]
    return pa.table(values, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
