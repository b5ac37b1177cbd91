"""Shared parts of the llm operators: word hashing over raw UTF-8, columnar blocks, written tables.

The heavy operators look at every word of every text.  A word of a batch is never a Python object here:
one pass over the batch's bytes finds the words and gives each a 64-bit hash, and windows of words are
combined from those with a few array operations.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import drop_since, mark, written  # noqa: F401
from ..sources.store import drop as drop_written  # noqa: F401

#: Bytes that separate words in the contracts: 0x20 and 0x09-0x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: Texts of one Arrow batch, so that long documents stay within an executor's memory.
ROWS_PER_BATCH = 256
#: Bytes of text hashed at once (one longer document is taken alone).
BYTES_AT_ONCE = 1 << 18
MASK64 = (1 << 64) - 1
#: Stands for a null doc_id, so that one that is this number is taken for null in orders.
NULL_ID = (1 << 63) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """n well mixed 64-bit values from a seed."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(separators: bytes, fold: bool) -> np.ndarray:
    """A random 64-bit value per byte, 0 for separators; fold gives A-Z the values of a-z."""
    table = splitmix(0x5EED, 256) | np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


WORDS = byte_table(SEPARATORS, fold=False)
FOLDED_WORDS = byte_table(SEPARATORS, fold=True)
#: Runs of ASCII letters, digits and any byte of a longer UTF-8 sequence, A-Z folded.
TERMS = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()), fold=True)

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd multiplier, for the place of a byte in its word."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 64), np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
    return _powers


class Words:
    """The words of some texts: hash, text index, first byte and length of each, in order."""

    __slots__ = ("hash", "text", "start", "size", "first", "raw", "bounds", "table")

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, table: np.ndarray = WORDS):
        """raw: the texts' bytes on end; bounds: n + 1 offsets into them, from 0."""
        self.raw, self.bounds, self.table = raw, bounds, table
        value = table[raw]
        inside = value != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = bounds[:-1]
        at = at[at < len(raw)]
        begins[at] = inside[at]
        self.start = np.flatnonzero(begins)
        n = len(self.start)
        if n:
            ends = np.append(self.start[1:], len(raw))
            place = np.arange(self.start[0], len(raw)) - np.repeat(self.start, ends - self.start)
            # separators after a word have value 0, whatever their place
            value = value[self.start[0] :] * powers(int(place.max()) + 1)[place]
            local = self.start - self.start[0]
            summed = np.add.reduceat(value, local)
            self.size = np.add.reduceat(inside[self.start[0] :].astype(np.int64), local)
            self.hash = mix(summed + self.size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        else:
            self.hash, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: words before each text, n + 1 entries
        self.first = np.searchsorted(self.start, bounds)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))

    def prefixes(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of each word, 0 for words that aren't longer."""
        long = self.size > k
        at = self.start[long]
        total = np.zeros(len(at), np.uint64)
        for i in range(k):
            total += self.table[self.raw[at + i]] * powers(k)[i]
        out = np.zeros(len(self.start), np.uint64)
        out[long] = mix(total + np.uint64(0xE7037ED1A0B428DB * k & MASK64))
        return out

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of k words within one text."""
        h = self.hash if hashes is None else hashes
        rolled = roll(h, k)
        at = np.arange(len(rolled))
        if len(rolled):
            keep = self.text[: len(rolled)] == self.text[k - 1 : k - 1 + len(rolled)]
            return rolled[keep], at[keep]
        return rolled, at


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial of every k values on end, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, span, whole, done = 0x9FB21C651E98DF25, h, None, 0
    width = 1
    while True:
        if k & width:
            if whole is None:
                whole = span
            else:
                n = min(len(whole), len(span) - done)
                factor = np.uint64(pow(0x9FB21C651E98DF25, width, 1 << 64))
                whole = whole[:n] * factor + span[done : done + n]
            done += width
        width *= 2
        if width > k:
            break
        span = span[: len(span) - width // 2] * np.uint64(power) + span[width // 2 :]
        power = power * power & MASK64
    return mix(whole[: len(h) - k + 1] + np.uint64(k))


def text_blocks(column: pa.Array):
    """(first row, rows, raw bytes, bounds) of consecutive rows of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BYTES_AT_ONCE, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def ids_of(column: pa.Array) -> np.ndarray:
    """doc_id as int64, null as the largest value."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bounds the rows of an Arrow batch of this session: a batch of whole texts must fit in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Gives this process's free blocks back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back is not None:
        give_back(0)


def release(spark: SparkSession) -> None:
    """Gives back what the driver no longer refers to: its own free blocks, and the JVM's dead broadcasts, shuffles and heap."""
    gc.collect()  # Python's handles keep JVM objects alive
    trim()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_memory: dict = {}


def remembered(key, make):
    """A worker's own object for a key; only the last key's object is kept, as workers serve many stages."""
    if key not in _memory:
        forget()
        _memory[key] = make()
        trim()  # building it leaves about as much behind
    return _memory[key]


def forget() -> None:
    """Frees what an earlier stage left in this worker, and gives it back to the system."""
    _memory.clear()
    trim()


def packed(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array.astype(kind, copy=False)).tobytes()


def joined(blobs, kind: str) -> np.ndarray:
    """The arrays of a column of binaries, on end."""
    return np.frombuffer(b"".join(x for x in blobs if x), dtype=kind)


def crc_of_id(column: str = "doc_id"):
    """crc32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def split_by(order_key: np.ndarray, n: int):
    """(key, rows) for the keys 0..n-1 that occur, by one stable sort."""
    order = np.argsort(order_key, kind="stable")
    edges = np.searchsorted(order_key[order], np.arange(n + 1))
    for k in range(n):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]
