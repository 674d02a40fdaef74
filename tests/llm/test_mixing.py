import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGES
from pyspark.sql import functions as F

from sieverank.llm import bits, following, mixing


def corpus(seed=9, count=300):
    rng = random.Random(seed)
    sets = [["the", "of", "and", "thing"], ["der", "die", "und", "Ding"]]
    rows = []
    for i in range(count):
        words = sets[i % 2]
        made = [rng.choice(words) if rng.random() < 0.7 else rng.choice(words) + rng.choice(["ing", "er", "en"]) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(made)))
    return rows


def tokens(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        small = small.replace(c, " ")
    return [w for w in small.split(" ") if w] + [None]


def test_base_scores_equal_counting(documents_of):
    rows = [*corpus(), *((i if i is None else i + 1_000, t) for i, t in EDGES)]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = {}
    for i, text in rows:
        if not held[i]:
            for word in tokens(text):
                counts[word] = counts.get(word, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    frame = documents_of(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    found = {r.doc_id: r for r in mixing.score(frame).collect()}
    for i, text in rows:
        row, words = found[i], tokens(text)
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in words)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[i], len(words), total)
        assert row.n_known == sum(w in counts for w in words)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
        assert row.score < 0 and row.bits_per_byte > 0
    out = [r for i, r in found.items() if held[i] and i < 1_000]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def fitted(table, add, gates, orders, rounds=6):
    model = bits.Model.equal(gates, orders)
    for _ in range(rounds):
        sums = bits.Sums(model)
        add(table, sums)
        model = model.after(sums)
    return model


def test_spellings_are_probabilities():
    """No set of distinct tokens has more probability than there is."""
    words = sorted({w for _, t in corpus() for w in tokens(t) if w})
    spelled = [w.encode() for w in words] + [b"\n"]
    counts, spans = np.arange(1, len(spelled) + 1), np.full(len(spelled), mixing.HEAD_BYTES)
    code = mixing.Code(np.bincount(np.frombuffer(b" ".join(spelled), np.uint8), minlength=256))
    table = np.zeros((mixing.SLOTS[-1], 2))
    mixing.counted(spelled, counts, spans, table, code)
    table = table.astype(np.float32)
    model = fitted(table, lambda t, sums: mixing.gathered(spelled, counts, spans, t, code, sums), bits.GATES, mixing.ORDERS)
    cost = mixing.costs_of(spelled, counts, spans, (bits.stretched(table), table[mixing.SLOTS[-2] :]), model, code)
    assert 0.5 < (10**cost).sum() <= 1 + 1e-9


def test_a_shared_beginning_is_worked_on_once():
    words = sorted({w for _, t in corpus() for w in tokens(t) if w} | {"über", "übe", "a", "thingthing"}, key=str.encode)
    spelled, counts = [*(w.encode() for w in words), b"\n"], np.arange(3, len(words) + 4)
    code = mixing.Code(np.bincount(np.frombuffer(b" ".join(spelled), np.uint8), minlength=256))
    found = mixing.Spelled(spelled, np.full(len(spelled), mixing.HEAD_BYTES), code)
    often = {}
    for word, count in zip(spelled, counts.tolist(), strict=True):
        word = word if word == b"\n" else word + b" "
        for n in range(1, len(word) + 1):
            often[word[:n]] = often.get(word[:n], 0) + count
    assert sum(len(w) for w in spelled) > len(found.bytes) == len(often)
    weight = found.weights(counts)
    for word, head, size in zip(spelled, found.heads, found.sizes, strict=True):
        word = word if word == b"\n" else word + b" "
        assert weight[found.place[head : head + size]].tolist() == [often[word[:n]] for n in range(1, size + 1)]
    for at, node, bit, exact in found.bits(weight):
        for place, n, b, pair in zip(at.tolist(), node, bit, exact, strict=True):
            token = int(np.searchsorted(np.append(found.heads, len(found.place)), np.flatnonzero(found.place == place)[0], side="right")) - 1
            head = (spelled[token] + b" ")[: np.flatnonzero(found.place == place)[0] - found.heads[token]]
            if len(head) < mixing.HEAD_BYTES:
                assert (pair == -1).all()
                continue
            nth = next(i for i in range(code.length[found.bytes[place]]) if code.node[i, found.bytes[place]] == n)
            same = {k[-1]: v for k, v in often.items() if k[:-1] == head and code.length[k[-1]] > nth and code.node[nth, k[-1]] == n}
            want = [sum(v for k, v in same.items() if code.bit[nth, k] == x) for x in (0, 1)]
            assert pair.tolist() == want and want[b] > 0


def test_small_counts_are_packed_without_empty_places():
    block = np.random.default_rng(3).integers(0, 256, (1 << 14, 2)).astype(np.float64)
    assert bits._packed(block)[0] == 1 and (bits._unpacked(bits._packed(block)) == block).all()


def test_groups_stay_whole_in_batches():
    words = sorted(f"{head}{n}" for head in ("abcde", "abcdf", "b", "überall", "zzzzzzz") for n in range(2_000))
    spans = [10 if w.startswith("zz") else 5 for w in words]
    table = pa.table({"word": words, "c": np.arange(len(words)), "span": pa.array(spans, pa.int32())})
    for size in (700, 3_000, 20_000):
        found = [part for _, part, *_ in mixing._batches(iter(table.to_batches(size)))]
        assert [w for part in found for w in part] == [w.encode() for w in words] and len(found) > 1
        span = dict(zip(map(str.encode, words), spans, strict=True))
        heads = [{w[: span[w]] for w in part} for part in found]
        assert sum(map(len, heads)) == len(set().union(*heads))


def sequences(rows, frequent, code):
    words = [w or "\n" for _, t in rows for w in tokens(t)]
    sizes = [len(tokens(t)) for _, t in rows]
    symbol = following.symbols(pa.array(words), frequent)
    return following.Sequences(symbol, np.cumsum(sizes) - sizes, code)


def followers():
    """Texts where "a" is followed by "b" or "c" and those tell what comes next; rare words lie between."""
    rng, rows = random.Random(4), []
    after = {"a": "bc", "b": "d", "c": "ef", "d": "a", "e": "a", "f": "ab"}
    for i in range(400):
        at, made = "a", []
        for n in range(rng.randint(1, 60)):
            made.append(at)
            at = rng.choice(after[at])
            if rng.random() < 0.1:
                made.append(f"rare{n}in{i % 10}x{n % 3}")
        rows.append((i, " ".join(made)))
    return rows


def test_following_equals_a_loop_over_bits():
    rows, frequent = followers()[:60], pa.array([*"abcdef", "\n"])
    code = mixing.Code(np.array([9, 7, 5, 5, 4, 3, 2, 6]))
    found = sequences(rows, frequent, code)
    table = np.zeros((following.SLOTS[-1], 2))
    following.counted(found, table)
    table = table.astype(np.float32)
    model = fitted(table, lambda t, sums: following.gathered(found, t, sums), bits.GATES, following.ORDERS)
    cost = following.Ready(table, model).cost(found)
    # The same from dictionaries keyed by the contexts themselves, word by word.
    names, often = [], set(frequent.to_pylist())
    for _, text in rows:
        words = [w or "\n" for w in tokens(text)]
        for i, word in enumerate(words):
            ending = lambda w: w if w in often else ("rare", w[-3:])
            before = [ending(w) for w in words[:i]]
            known = [w for w in words[:i] if w in often]
            names.append((word, [(), (before[-1:],), (before[-2:], len(before[-2:])), (known[-2:], 0)]))
    counts = {}
    number = {w: i for i, w in enumerate(frequent.to_pylist())}
    steps = lambda word: [(code.node[n, s], code.bit[n, s]) for s in [number.get(word, len(number))] for n in range(code.length[s])]
    for word, contexts in names:
        for node, bit in steps(word):
            for order, context in enumerate(contexts):
                counts.setdefault((order, str(context), node), [0, 0])[bit] += 1
    for (word, contexts), total in zip(names, cost, strict=True):
        want = 0.0
        for node, bit in steps(word):
            seen = [counts[order, str(context), node] for order, context in enumerate(contexts)]
            inputs = [math.log((one + 0.4) / (zero + 0.4)) for zero, one in seen]
            near, far = (math.log2(1 + sum(seen[order])) for order in (1, 2))
            gate = int(min(far, 7)) * 4 + int(min(near / 4, 3))
            line = sum(float(w) * x for w, x in zip(model.weights[gate], inputs, strict=True))
            mixed = 1 / (1 + math.exp(-max(-16, min(16, line))))
            cell = model.cells[gate, max(-16, min(16, round(line * 2))) + 16]
            one = (mixed + min(max(cell[1] / cell.sum(), 1e-6), 1 - 1e-6)) / 2
            want += math.log10(one if bit else 1 - one)
        assert total == pytest.approx(want, abs=2e-3)


def test_what_follows_the_same_words_is_looked_up_once():
    """The time of following words grows with what is told apart, not with how often it occurs."""
    rows, frequent, code = followers()[:40], pa.array([*"abcdef", "\n"]), mixing.Code(np.array([9, 7, 5, 5, 4, 3, 2, 6]))
    once, often = sequences(rows, frequent, code), sequences(rows * 50, frequent, code)
    tables, costs, bits_of = [], [], []
    for found in (once, often):
        tables.append(np.zeros((following.SLOTS[-1], 2)))
        following.counted(found, tables[-1])
    assert (tables[1] == 50 * tables[0]).all() and tables[0][:7].sum() == code.length[once.coded].sum()
    model = bits.Model.equal(bits.GATES, following.ORDERS)
    for found in (once, often):
        ready, seen = following.Ready(tables[0].astype(np.float32), model), []
        ready.model.cost = lambda inputs, gate, bit, seen=seen: seen.append(len(bit)) or bits.Model.cost(model, inputs, gate, bit)
        costs.append(ready.cost(found))
        bits_of.append(sum(seen))
    assert costs[1] == pytest.approx(np.tile(costs[0], 50), abs=1e-12)
    assert bits_of[1] == bits_of[0] < code.length[once.coded].sum()


def test_sums_of_gates_equal_a_loop():
    rng, size = np.random.default_rng(7), 300
    inputs, gate, bit = rng.normal(size=(3, size)).astype(np.float32), rng.integers(0, 5, size) * 2, rng.integers(0, 2, size)
    model = bits.Model.equal(12, 3)
    model = bits.Model((model.weights + rng.normal(size=(12, 3)) / 9).astype(np.float32), model.cells)
    for weight in (np.ones(size), rng.integers(1, 9, size).astype(np.float64)):
        sums = bits.Sums(model)
        sums.add(inputs, gate, bit, weight)
        slope, curve, cells = np.zeros((12, 3)), np.zeros((12, 3, 3)), np.zeros((12, bits.COLUMNS, 2))
        for n in range(size):
            x = inputs[:, n].astype(np.float64)
            line = float(x @ model.weights[gate[n]])
            chance = 1 / (1 + math.exp(-line))
            slope[gate[n]] += weight[n] * (bit[n] - chance) * x
            curve[gate[n]] += weight[n] * chance * (1 - chance) * np.outer(x, x)
            cells[gate[n], round(line * 2) + 16, bit[n]] += weight[n]
        assert sums.slope == pytest.approx(slope, abs=1e-4) and np.tril(sums.curve) == pytest.approx(np.tril(curve), abs=1e-4)
        assert (sums.cells == cells).all()


def test_next_numbers_are_a_distribution():
    """After the same words, the probabilities of all numbers add up to 1."""
    frequent, code = pa.array([*"abcdef"]), mixing.Code(np.array([9, 7, 5, 5, 4, 3, 2]))
    found = sequences(followers(), frequent, code)
    table = np.zeros((following.SLOTS[-1], 2))
    following.counted(found, table)
    table = table.astype(np.float32)
    ready = following.Ready(table, fitted(table, lambda t, sums: following.gathered(found, t, sums), bits.GATES, following.ORDERS))
    start = [0, 3, 8, 1]
    every = np.array([[*start, last] for last in range(7)])
    cost = ready.cost(following.Sequences(every.ravel(), np.arange(7) * 5, code)).reshape(7, 5)
    assert (10 ** cost[:, -1]).sum() == pytest.approx(1)


def test_order_of_words_counts(documents_of):
    rows, rng = followers(), random.Random(5)
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    mixed = []
    for n in range(10_000, 30_000):
        if zlib.crc32(str(n).encode()) % 7 == 2 and len(mixed) < len(held):
            words = held[len(mixed)][1].split(" ")
            rng.shuffle(words)
            mixed.append((n, " ".join(words)))
    found = {r.doc_id: r for r in mixing.score(documents_of([*rows, *mixed])).collect()}
    true, shuffled = (sum(found[i].score for i, _ in part) for part in (held, mixed))
    assert sum(found[i].base_score for i, _ in held) == pytest.approx(sum(found[i].base_score for i, _ in mixed))
    assert true > 0.8 * shuffled
    assert true > sum(found[i].base_score for i, _ in held)


def test_partitioning_changes_nothing(spark, documents_of):
    rows, before = corpus(count=120), spark.conf.get("spark.sql.shuffle.partitions")
    scores = []
    for parts in (2, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        found = mixing.score(documents_of(rows).repartition(parts, "doc_id")).collect()
        scores.append([r.score for r in sorted(found, key=lambda r: r.doc_id)])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert scores[0] == pytest.approx(scores[1], rel=1e-5)


def test_a_beginning_of_many_words_is_parted(spark, monkeypatch):
    """Groups stay small, whatever the words begin with, and a token's beginnings are exact from its span on."""
    monkeypatch.setattr(mixing, "GROUP_BYTES", 400)
    words = [f"https://{i % 5}.example/{i}" for i in range(300)] + [f"w{i}" for i in range(20)] + ["https", "https://"]
    found = mixing.with_spans(spark.createDataFrame([(w, 1) for w in words], "word string, c long")).collect()
    groups = {}
    for row in found:
        groups.setdefault(row.word.encode()[: row.span], []).append(row)
    assert sorted(r.word for r in found) == sorted(words)
    assert all(sum(len(r.word) + 1 for r in rows) <= 400 or len(rows) == 1 for rows in groups.values())
    for head, rows in groups.items():
        assert len({r.span for r in rows if len(r.word) >= len(head)}) == 1
        assert len(head) < rows[0].span or all(r in rows for r in found if r.word.encode().startswith(head))


def test_code_is_prefix_free_and_short_for_frequent_bytes():
    counts = np.zeros(256)
    counts[101], counts[32] = 1_000, 500
    code = mixing.Code(counts)
    words = ["".join(str(code.bit[n, b]) for n in range(code.length[b])) for b in range(256)]
    assert len(set(words)) == 256 and math.isclose(sum(2.0 ** -len(w) for w in words), 1)
    assert len(words[101]) < len(words[32]) < len(words[0])


def test_empty_table(documents_of):
    assert mixing.score(documents_of(EDGES).filter(F.lit(False))).count() == 0


def test_packed_counts_come_back():
    block = np.random.default_rng(3).integers(0, 2**53, (64, 2)).astype(np.float64)
    block[:50] = 0
    assert (bits._unpacked(bits._packed(block)) == block).all()


def test_a_chunk_is_scored_in_steps():
    """What a chunk takes beside its rows and eight numbers a word does not grow with its texts."""
    rng, words, rows = np.random.default_rng(6), 150_000, 400
    numbers = rng.integers(0, words, 4_000_000)
    packed = [mixing.packed_numbers(part, words).tobytes() for part in np.split(numbers, rows)]
    left = pa.table({"chunk": np.zeros(rows, np.int64), "doc_id": np.arange(rows), "held_out": pa.array([False] * rows), "tokens": pa.array(packed, pa.binary())})
    size = rng.integers(2, 9, words).astype(np.int32)
    right = pa.table({"of_chunk": np.zeros(words, np.int64), "number": np.arange(words, dtype=np.int32), "bytes": size, "c": rng.integers(0, 5, words),
                      "cost": -rng.random(words, dtype=np.float32), "groups": np.full(words, 0x0101010101010101), "symbol": np.full(words, 9, np.int32)})
    code = mixing.Code(np.array([5, 3, 2]))
    model = bits.Model.equal(bits.GATES, following.ORDERS)
    ready = following.Ready(np.zeros((following.SLOTS[-1], 2), np.float32), model)
    shares = np.full(mixing.GROUPS, 1 / mixing.GROUPS)
    tracemalloc.start()
    found = mixing._summed(left, right, 100, 10, shares, np.log10(shares), ready, 2, code)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("n_tokens").to_pylist() == [10_000] * rows
    text = numbers.reshape(rows, -1)
    assert found.column("n_known").to_numpy() == pytest.approx((right.column("c").to_numpy()[text] > 0).sum(axis=1))
    spelled = size[text].sum(axis=1)
    assert found.column("bits_per_byte").to_numpy() == pytest.approx(found.column("score").to_numpy() / -math.log10(2) / spelled)
    assert peak < 48 << 20
