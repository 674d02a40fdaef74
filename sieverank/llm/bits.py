"""Bits predicted by several contexts: a Huffman code, gated logistic mixing, a refining map, tables of counts.

Weights and map are learned online, in rounds of growing parts of what there is to learn from. In a round every
task predicts its bits with the weights so far and sums what the step needs; then each gate's weights take one
damped Newton step on the logistic loss, and the map adds what followed each prediction. Which row is in which
round goes by a hash and all sums are over rows, so the partitioning changes nothing. A bit's probability is the
mean of the mixed and the mapped one.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.session import cut

BLOCK_SLOTS = 1 << 14
_HEAD = struct.Struct("<BI")
LEVELS, COLUMNS = 8, 33
STEP = 1 << 14
LOG10_E = float(np.log10(np.e))
GATES = LEVELS * 4
#: The sum of the equal weights that learning starts at, and how much a step is held back.
START, RIDGE = 1.2, 4.0
#: Rows fall into shares by a hash; a round takes the shares up to its limit that no round before took.
SHARES = 32
ROUNDS = (0, 1, 2, 4, 8, 16, SHARES)


class Code:
    """A Huffman code over symbols: per symbol its bits and the tree's nodes on the way to it."""

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for node in range(size, 2 * size - 1):
            low, high = heapq.heappop(heap), heapq.heappop(heap)
            parent[low[2]], parent[high[2]] = (node, 0), (node, 1)
            heapq.heappush(heap, (low[0] + high[0], node, node))
        paths = []
        for symbol in range(size):
            path, at = [], symbol
            while at != 2 * size - 2:
                at, bit = parent[at]
                path.append((at - size, bit))
            paths.append(path[::-1])
        self.length = np.array([len(path) for path in paths])
        self.node, self.bit = np.zeros((2, self.length.max(), size), np.int64)
        for symbol, path in enumerate(paths):
            for nth, (node, bit) in enumerate(path):
                self.node[nth, symbol], self.bit[nth, symbol] = node, bit


def stretched(pair: np.ndarray) -> np.ndarray:
    """The logarithm of ones to zeros, each with a little added."""
    return np.log((pair[:, 1] + np.float32(0.4)) / (pair[:, 0] + np.float32(0.4)))


def stretched_without(pair: np.ndarray) -> np.ndarray:
    """(slots, 2): the same for a bit's own prediction, that is with one zero less for a zero and one one less for a one."""
    found = np.empty((len(pair), 2), np.float32)
    for bit in range(2):
        found[:, bit] = stretched(without(pair, bit))
    return found


def without(pair: np.ndarray, bit: int) -> np.ndarray:
    """The counts less one occurrence of the bit."""
    return np.maximum(pair - np.array([1 - bit, bit], np.float32), 0)


def squash(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -16, 16)))


def columns_of(line: np.ndarray) -> np.ndarray:
    """The map's column of a stretched prediction: steps of half from -8 to 8."""
    return np.clip(np.rint(line * 2), -16, 16).astype(np.int64) + 16


class Model:
    """Weights per gate, (gates, orders), and the map's counts, (gates, columns, 2)."""

    def __init__(self, weights: np.ndarray, cells: np.ndarray):
        self.weights, self.cells = weights, cells
        self.columns = np.ascontiguousarray(weights.T)
        self.refine = (cells[:, :, 1] / cells.sum(axis=2)).clip(1e-6, 1 - 1e-6)

    @classmethod
    def equal(cls, gates: int, orders: int) -> Model:
        """What learning starts from: equal weights, and a map that changes nothing."""
        centres = squash((np.arange(COLUMNS) - 16) / 2.0)
        cells = np.broadcast_to(np.stack([1 - centres, centres], axis=1) * 4.0, (gates, COLUMNS, 2))
        return cls(np.full((gates, orders), START / orders, np.float32), cells)

    def line(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        line = inputs[0] * self.columns[0].take(gate)
        for order in range(1, len(inputs)):
            line += inputs[order] * self.columns[order].take(gate)
        return line

    def chance(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The probability of a one, from (orders, bits) stretched predictions."""
        line = self.line(inputs, gate)
        return (squash(line) + self.refine.take(gate * COLUMNS + columns_of(line))) / 2

    def cost(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        one = self.chance(inputs, gate)
        return np.log(np.where(bit == 1, one, 1 - one)) * LOG10_E

    def after(self, sums: Sums) -> Model:
        """The model one round later."""
        lower = np.tril(sums.curve)
        curve = lower + np.transpose(np.tril(lower, -1), (0, 2, 1)) + RIDGE * np.eye(lower.shape[1])
        step = np.linalg.solve(curve, sums.slope[:, :, None])[:, :, 0]
        return Model(np.clip(self.weights + np.clip(step, -0.5, 0.5), -1, 2).astype(np.float32), self.cells + sums.cells)


class Sums:
    """Slopes, curvatures and followed predictions, per gate, of bits predicted by a model."""

    def __init__(self, model: Model):
        gates, orders = model.weights.shape
        self.model = model
        shapes = [(gates, orders), (gates, orders, orders), (gates, COLUMNS, 2)]
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
        self.values = np.zeros(ends[-1])
        self.slope, self.curve, self.cells = (part.reshape(shape) for part, shape in zip(np.split(self.values, ends[:-1]), shapes, strict=True))

    def add(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None) -> None:
        """Adds bits, each as often as ``weight`` tells, or once."""
        for at in range(0, len(bit), STEP):
            part = slice(at, at + STEP)
            self._add(inputs[:, part], gate[part], bit[part], None if weight is None else weight[part])

    def _add(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None) -> None:
        gates, orders = self.slope.shape
        # The bits of a gate go together, so that its sums are a product of matrices.
        place, sizes = np.argsort(gate.astype(np.uint8), kind="stable"), np.bincount(gate, minlength=gates)
        inputs, bit = inputs.take(place, axis=1), bit.take(place)
        line = inputs[0] * np.repeat(self.model.columns[0], sizes)
        for order in range(1, orders):
            line += inputs[order] * np.repeat(self.model.columns[order], sizes)
        chance = squash(line)
        lines, held = inputs.astype(np.float64), np.empty((orders + 1, len(bit)))
        steep = chance * (1 - chance)
        np.subtract(bit, chance, out=held[orders])
        if weight is not None:
            weight = weight.take(place)
            steep, held[orders] = weight * steep, weight * held[orders]
        np.multiply(lines, steep, out=held[:orders])
        ends = np.cumsum(sizes)
        for one in np.flatnonzero(sizes):
            part = slice(ends[one] - sizes[one], ends[one])
            found = held[:, part] @ lines[:, part].T
            self.curve[one] += found[:orders]
            self.slope[one] += found[orders]
        cell = (np.repeat(np.arange(gates) * COLUMNS, sizes) + columns_of(line)) * 2 + bit
        self.cells += np.bincount(cell, weight, gates * COLUMNS * 2).reshape(self.cells.shape)

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(self.values))), pa.array(self.values)], ["at", "value"])


def learned(source: DataFrame, share: Column, gather: Callable[[Iterator[pa.RecordBatch], Sums], None], gates: int, orders: int, ready=None) -> Model:
    """The model after all rounds over ``source``; ``gather`` adds a task's batches to the sums.

    ``share`` says which of ``SHARES`` a row is in; ``ready`` prepares a round's rows, by a shuffle for example. As many
    rows as there are weights and cells come to the driver each round.
    """
    model = Model.equal(gates, orders)
    for low, high in zip(ROUNDS[:-1], ROUNDS[1:], strict=True):
        part = source.filter((share >= low) & (share < high))

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            sums = Sums(model)
            gather(batches, sums)
            yield sums.row()

        found = (ready(part) if ready else part).mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        sums = Sums(model)
        sums.values[found.column("at").to_numpy()] = found.column("value").to_numpy()
        model = model.after(sums)
    return model


def table_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table of counts, (slots, 2), in blocks; blocks of zeros are left out."""
    group = TaskContext.get().partitionId() // 64
    for at in range(0, len(table), BLOCK_SLOTS):
        block = table[at : at + BLOCK_SLOTS]
        if block.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([at // BLOCK_SLOTS]), pa.array([group]), pa.array([_packed(block)], pa.binary())], ["block", "part", "counts"]
            )


def summed_tables(source: DataFrame, run: Callable, size: int) -> np.ndarray:
    """The sum of all tasks' tables, whose size is fixed.

    Blocks are summed in two steps, so that a sum never meets more than a bounded number of them at once.
    """

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros((1, 2))
        for counts in rows.column("counts"):
            total = total + _unpacked(counts.as_py())
        cells = [pa.array([rows.column(c)[0].as_py()], pa.int64()) for c in ("block", "part")]
        return pa.table([*cells, pa.array([_packed(total)], pa.binary())], names=["block", "part", "counts"])

    schema = "block long, part long, counts binary"
    blocks = source.mapInArrow(run, schema)
    summed = blocks.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    table = np.zeros((size, 2), np.float32)
    for row in cut(summed, "counts").toLocalIterator():
        at = row["block"] * BLOCK_SLOTS
        part = _unpacked(row["counts"])
        table[at : at + len(part)] = part
    return table


def _packed(block: np.ndarray) -> bytes:
    """Counts are whole and most are small or zero: their bytes go place by place, as many places as the largest has."""
    counts = block.astype("<u8")
    places = max(1, -(-int(counts.max()).bit_length() // 8))
    data = np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 8)[:, :places].T)
    return _HEAD.pack(places, data.nbytes) + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    places, size = _HEAD.unpack_from(data)
    planes = np.frombuffer(pa.decompress(memoryview(data)[_HEAD.size :], size, "zstd"), np.uint8).reshape(places, -1)
    counts = np.zeros((planes.shape[1], 8), np.uint8)
    counts[:, :places] = planes.T
    return counts.view("<u8").reshape(-1, 2).astype(np.float64)
