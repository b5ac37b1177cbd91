"""Count-min sketches of 64-bit hashes, built by partition, merged by cell range, kept as saturating counts.

A row of the sketch has ``width`` cells.  Only whether a cell is hit twice matters to the callers, so a
partition sends, for each slice of 65,536 cells and each row, the cells it hit (two bytes each) and those it
hit twice; the merge adds them, in two steps where there are many, and keeps one bit per cell.  What moves follows
the hashes, not tasks x width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

DEPTH = 2
SLICE_BITS = 16
#: log2 of the widest row: 2 rows x 2^28 cells are 64 MB, whatever the corpus.
MIN_BITS, MAX_BITS = 18, 28
#: The same for a row of counts of a byte: 32 MB.
MAX_COUNT_BITS = 25
PARTS = "slice int, once binary, twice binary"


def width_bits(n: int) -> int:
    """Cells for about n hashes: eight each, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, int(max(1, 8 * n) - 1).bit_length()))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return c.mix(hashes + np.uint64(0x632BE59BD9B4E019 * (row + 1) & c.MASK64)) >> np.uint64(64 - bits)


def partition_rows(hashes: np.ndarray, bits: int, depth: int = DEPTH):
    """A partition's part of the sketch as a record batch; hashes has one entry for each occurrence."""
    per_row = 1 << bits - SLICE_BITS
    out: tuple[list, list, list] = ([], [], [])
    for row in range(depth):
        cell = np.sort(cells(hashes, row, bits))
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        at = np.flatnonzero(first)
        more = np.diff(np.append(at, len(cell))) > 1
        unique = cell[at]
        low = (unique & np.uint64(0xFFFF)).astype("<u2")
        slices = (unique >> np.uint64(SLICE_BITS)).astype(np.int64)
        edges = np.searchsorted(slices, np.arange(per_row + 1))
        for s in np.flatnonzero(np.diff(edges)):
            a, b = edges[s], edges[s + 1]
            out[0].append(row * per_row + int(s))
            out[1].append(low[a:b].tobytes())
            out[2].append(low[a:b][more[a:b]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["slice", "once", "twice"])


#: Parts of a sketch that a task of a merge holds, at most; more are merged in two steps.
FAN_IN = 256


def gathered(parts: DataFrame, add) -> DataFrame:
    """The parts of a slice as few as FAN_IN: where more partitions send some, groups of them are added first.

    add: from lists of (once, twice) blobs to one pair of them."""
    n = parts.rdd.getNumPartitions()  # the scan's; nothing runs
    if n <= FAN_IN:
        return parts
    groups = -(-n // FAN_IN)

    def some(key, table):
        once, twice = add(table.column("once").to_pylist(), table.column("twice").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "once": pa.array([once], pa.binary()), "twice": pa.array([twice], pa.binary())})

    return parts.withColumn("grp", F.spark_partition_id() % groups).groupBy("slice", "grp").applyInArrow(some, PARTS)


def merged(parts: DataFrame) -> DataFrame:
    """slice, bits: a bit for each cell of the slice that was hit twice or more."""

    def both(once: list[bytes], twice: list[bytes]) -> tuple[bytes, bytes]:
        count = np.zeros(1 << SLICE_BITS, np.uint8)
        for blob in (*once, *twice):
            at = np.frombuffer(blob, "<u2")
            count[at] = np.minimum(count[at] + 1, 2)
        return tuple(np.flatnonzero(count >= k).astype("<u2").tobytes() for k in (1, 2))

    def add(key, table):
        count = np.zeros(1 << SLICE_BITS, np.uint8)
        for once, twice in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
            for blob in (once, twice):  # cells of a part differ from each other
                at = np.frombuffer(blob, "<u2")
                count[at] = np.minimum(count[at] + 1, 2)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())})

    return gathered(parts, both).groupBy("slice").applyInArrow(add, "slice int, bits binary")


def count_rows(hashes: np.ndarray, bits: int):
    """A partition's part of one row of counts: cells of each slice and their counts, up to 255."""
    cell, count = np.unique(cells(hashes, 0, bits), return_counts=True)
    low = (cell & np.uint64(0xFFFF)).astype("<u2")
    slices = (cell >> np.uint64(SLICE_BITS)).astype(np.int64)
    edges = np.searchsorted(slices, np.arange((1 << bits - SLICE_BITS) + 1))
    some = np.flatnonzero(np.diff(edges))
    count = np.minimum(count, 255).astype(np.uint8)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([low[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary()), pa.array([count[edges[s] : edges[s + 1]].tobytes() for s in some], pa.binary())], ["slice", "once", "twice"])


class Counts:
    """One merged row of counts up to 255, a byte a cell; never below the true count (or 255)."""

    def __init__(self, bits: int, blob: bytes | bytearray):
        self.bits, self.blob = bits, blob

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.blob, np.uint8)[cells(hashes, 0, self.bits)]


def collect_counts(parts: DataFrame, bits: int) -> Counts:
    """The merged counts on the driver, to be broadcast: 2^bits bytes."""
    size = 1 << SLICE_BITS

    def summed(cells_: list[bytes], counts: list[bytes]) -> np.ndarray:
        total = np.zeros(size, np.uint8)
        for cell, count in zip(cells_, counts, strict=True):
            at, n = np.frombuffer(cell, "<u2"), np.frombuffer(count, np.uint8)
            total[at] = np.minimum(total[at].astype(np.int64) + n, 255)
        return total

    def both(cells_: list[bytes], counts: list[bytes]) -> tuple[bytes, bytes]:
        total = summed(cells_, counts)
        some = np.flatnonzero(total)
        return some.astype("<u2").tobytes(), total[some].tobytes()

    def add(key, table):
        total = summed(table.column("once").to_pylist(), table.column("twice").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    blob = bytearray(1 << bits)
    for row in gathered(parts, both).groupBy("slice").applyInArrow(add, "slice int, bits binary").toLocalIterator(prefetchPartitions=True):
        blob[row[0] * size : (row[0] + 1) * size] = row[1]
    return Counts(bits, blob)


class Repeated:
    """The merged sketch: which hashes are estimated to occur twice or more.  Never a repeated one missed."""

    def __init__(self, bits: int, blob: bytes | bytearray, depth: int = DEPTH):
        self.bits, self.blob, self.depth = bits, blob, depth
        self._array: np.ndarray | None = None

    def __getstate__(self):
        return self.bits, self.blob, self.depth

    def __setstate__(self, state):
        self.bits, self.blob, self.depth = state
        self._array = None

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self._array is None:
            self._array = np.frombuffer(self.blob, np.uint8).reshape(self.depth, -1)
        out = np.ones(len(hashes), bool)
        for row in range(self.depth):
            cell = cells(hashes, row, self.bits)
            out &= (self._array[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def collect(parts: DataFrame, bits: int, depth: int = DEPTH) -> Repeated:
    """The merged sketch on the driver, to be broadcast: depth x 2^bits / 8 bytes, 64 MB at most."""
    size = 1 << SLICE_BITS - 3
    blob = bytearray(depth << bits - 3)
    for row in merged(parts).toLocalIterator(prefetchPartitions=True):
        blob[row[0] * size : (row[0] + 1) * size] = row[1]
    return Repeated(bits, blob, depth)
