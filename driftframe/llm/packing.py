"""Packing by lexical retrieval: fixed windows of 2048 ids, filled with a seed document's BM25 neighbours.

1. Every text is tokenised once.  Its full windows are sequences as they are; what is left of it (its tail)
   is an item.  An item is placed by the smallest hash of its runs of ids, so that near copies and texts
   with the same phrases come to the same shard of the index.  The items are written to the shared folder.
2. They are range-partitioned by that hash and the id (a hash that a third of all items share is split by
   the id).  A partition is a run of index shards of bounded size.  In a shard, each seed asks the inverted
   index for its unused neighbours by BM25 score; those fill the window, the last one is cut to fit.
3. A shard's last, unfinished window moves to the next shard.  A partition's last window is cut into powers
   of two, which are not padded.

Null texts are empty texts (the end id alone), null ids are kept, repeated rows are packed separately, extra
columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .bpe import byte_letters
from .merges import BatchMerger

WINDOW, END = 2048, 1
#: Items of an index shard, and ids of a partition of items.
SHARD_ITEMS, PARTITION_IDS = 2048, 6_000_000
#: BM25's usual constants; neighbours taken at once, as often as wanted.
K1, B, NEIGHBOURS = 1.2, 0.75, 64
#: Ids of a run whose smallest hash places an item.
RUN = 8
#: Words that a worker remembers for good (about 80 MB), and the latest words met once, at most (150 MB).
CACHE, MET_ONCE = 400_000, 800_000
#: The same where other stages share the executors' memory (about 60 MB a worker).
LEAN_WORDS = 100_000, 200_000

ITEMS = "kind int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, place long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words between white space, which the tokeniser's cuts never cross; str.split() also cuts at 0x1c-0x1f.
CUT = re.compile("[^ \t\n\r]+")


#: Words of plain letters, whose lower case and composed form are those of their letters one by one.
#: A line: such a word and the stops after it, or any other.
PLAIN = re.compile("^(?:([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,48})([.,]*)|([^\n]+))$", re.MULTILINE)


def words_of(text: str) -> list[str]:
    return CUT.findall(text) if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text else text.split()


class Memory(dict):
    """Ids of words met twice or more.  A word that isn't there is put into ``fresh`` and gives a buffer, filled later."""

    def __init__(self):
        self.fresh: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytearray:
        ids = self.fresh.get(word)
        if ids is None:
            self.fresh[word] = ids = bytearray()
        return ids


class WordTokenizer:
    """Ids of the tokenizers library, with a bounded memory of words.

    The normaliser and the pre-tokeniser of the file treat white space as a cut, so a text's ids are the ids
    of its words on end.  New words of plain letters are merged together (their merges are the file's); all
    others go to the library."""

    def __init__(self, path: str, words: tuple[int, int] = (CACHE, MET_ONCE)):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.merger = BatchMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        letters = {b: ch for ch, b in byte_letters().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.kind = "<u2" if len(vocab) < 1 << 16 and max(vocab.values()) < 1 << 16 else "<u4"
        self.cache, self.met_once = words
        self.known = Memory()
        self.young: dict[str, bytes] = {}  # words met once, the latest last
        self.unknown = 0  # words that found no room in the memory

    def library(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[w] = np.array(e.ids, self.kind).tobytes()
        return out

    def letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of plain letters in lower case."""
        if not words:
            return {}
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[data]
        last = np.cumsum(sizes) - 1
        ids[last] = self.last[data[last]]
        return dict(zip(words, self.merger.merge(ids, sizes, self.kind), strict=True))

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        if not words:
            return {}
        plain, cores, ends, others = [], [], [], []
        for w, (core, end, _) in zip(words, PLAIN.findall("\n".join(words)), strict=True):
            if core:
                plain.append(w)
                cores.append(core)
                ends.append(end)
            else:
                others.append(w)
        cores = "\n".join(cores).lower().split("\n") if cores else []
        of = self.letters(list(dict.fromkeys(cores)))
        end_of = {"": b""} | self.library([x for x in dict.fromkeys(ends) if x])
        out = self.library(others)
        out.update(zip(plain, [of[core] + end_of[end] for core, end in zip(cores, ends, strict=True)], strict=True))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found = [list(map(self.known.__getitem__, words_of(t))) for t in texts]
        self.learn()
        return [np.frombuffer(b"".join(row), self.kind) for row in found]

    def learn(self) -> None:
        """Fills the buffers of the fresh words and remembers them: at the second meeting for good."""
        known, young, fresh = self.known, self.young, self.known.fresh
        known.fresh = {}
        met = list(map(young.get, fresh))
        for (w, buffer), ids in zip(fresh.items(), met, strict=True):
            if ids is not None:
                buffer += ids
                if len(known) < self.cache:
                    known[w] = ids
                else:
                    self.unknown += 1
        new = self.encode_words([w for w, ids in zip(fresh, met, strict=True) if ids is None])
        for w, ids in new.items():
            fresh[w] += ids
        young.update(new)
        for w in [w for w in new if len(w) > 64]:
            del young[w]
        if len(young) > self.met_once:  # the older half goes
            self.young = dict(itertools.islice(young.items(), len(young) - self.met_once // 2, None))
        if self.unknown > 50 * self.cache:  # the texts have moved on: remember anew
            known.clear()
            self.unknown = 0


def worker(path: str, words: tuple[int, int]) -> WordTokenizer:
    return c.remembered(("packing", path, words), lambda: WordTokenizer(path, words))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def places_of(rows: list[np.ndarray]) -> list[int]:
    """For each row of ids the smallest hash of its runs of 8 ids (of its last ids, if it has fewer)."""
    if not rows:
        return []
    sizes = np.array([len(x) for x in rows])
    hashes = c.mix(np.concatenate(rows).astype(np.uint64))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(rows), np.uint64)
    long = np.flatnonzero(sizes >= RUN)
    if len(long):
        rolled = c.roll(hashes, RUN)
        # runs that begin in a row and end in it
        ends = np.zeros(len(rolled) + 2, np.int64)
        np.add.at(ends, starts[long], 1)
        np.add.at(ends, starts[long] + sizes[long] - RUN + 1, -1)
        inside = np.cumsum(ends)[: len(rolled)] > 0
        masked = np.where(inside, rolled, np.uint64(c.MASK64))
        edges = np.stack([starts[long], starts[long] + sizes[long] - RUN + 1], axis=1).ravel()
        out[long] = np.minimum.reduceat(np.append(masked, np.uint64(c.MASK64)), edges)[::2]
    for i in np.flatnonzero(sizes < RUN):
        out[i] = c.roll(hashes[starts[i] : starts[i] + sizes[i]], int(sizes[i]))[0]
    return out.view(np.int64).tolist()


def items(docs: DataFrame, path: str, window: int = WINDOW, words: tuple[int, int] = (CACHE, MET_ONCE)) -> DataFrame:
    """Full windows (kind 0, without ids) and tails (kind 1, with their ids)."""
    c.small_batches(docs.sparkSession)

    def run(batches):
        tokenizer = worker(path, words)
        for batch in batches:
            texts = tokenizer.ids([t or "" for t in batch.column(1).to_pylist()])
            texts = [np.append(ids, np.array([END], ids.dtype)) for ids in texts]
            placed = places_of([ids[len(ids) - len(ids) % window :] if len(ids) % window else ids[-window:] for ids in texts])
            rows = []
            for doc_id, ids, place in zip(batch.column(0).to_pylist(), texts, placed, strict=True):
                n = len(ids)
                tail = n - n % window
                rows += [(0, doc_id, i, window, crc(ids[i : i + window]), n, place, None) for i in range(0, tail, window)]
                if tail < n:
                    rows.append((1, doc_id, tail, n - tail, None, n, place, ids[tail:].tobytes()))
            columns = zip(*rows, strict=True) if rows else [()] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ITEMS)


SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])


class Index:
    """An inverted index over some items, with BM25 weights in its postings."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        sizes = np.array([len(x) for x in ids])
        keys = np.repeat(np.arange(n, dtype=np.int64), sizes) << 32 | np.concatenate(ids).astype(np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        self.item, term = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.uint32)
        del keys
        _, dense, df = np.unique(term, return_inverse=True, return_counts=True)
        dense = dense.astype(np.int32)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = self.idf[dense] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.item] / sizes.mean()))
        order = np.argsort(dense, kind="stable")
        self.postings, self.weights = self.item[order].astype(np.intp), weight[order]
        self.edges = np.concatenate([[0], np.cumsum(df)])
        self.dense, self.df, self.n = dense, df, n
        self.of_item = np.searchsorted(self.item, np.arange(n + 1))

    def scores(self, item: int) -> np.ndarray:
        """BM25 scores of all items for all terms of an item that others have."""
        terms = self.dense[self.of_item[item] : self.of_item[item + 1]]
        terms = terms[self.df[terms] > 1]
        sizes = self.df[terms]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(self.n)
        at = np.repeat(self.edges[terms] - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.bincount(self.postings[at], self.weights[at], self.n)


def fill(pool: list[tuple], window: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Full windows from the items (doc_id, start, doc_tokens, ids), and the pieces of the last, unfinished one."""
    index = Index([x[3] for x in pool])
    start = [0] * len(pool)  # ids of an item already placed
    left = np.array([len(x[3]) for x in pool])
    windows, pieces, space, cursor = [], [], window, 0

    def place(i: int, n: int) -> None:
        nonlocal space
        doc_id, first, total, ids = pool[i]
        pieces.append((doc_id, first + start[i], total, ids[start[i] : start[i] + n]))
        start[i] += n
        left[i] -= n
        space -= n

    while True:
        while cursor < len(pool) and not left[cursor]:
            cursor += 1
        if cursor == len(pool):
            return windows, pieces
        scores = index.scores(cursor)
        place(cursor, min(int(left[cursor]), space))
        while space:
            scores[left == 0] = 0
            best = np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS] if len(scores) > NEIGHBOURS else np.arange(len(scores))
            best = best[scores[best] > 0]
            best = best[np.argsort(-scores[best], kind="stable")]
            if not len(best):
                break
            for i in best[left[best] <= space]:
                if left[i] <= space:
                    place(int(i), int(left[i]))
            rest = best[left[best] > 0]
            if space and len(rest):  # none of the others fits: the nearest is cut
                place(int(rest[0]), space)
        while space and cursor < len(pool):  # no lexical neighbour is left: the next in order
            if left[cursor]:
                place(cursor, min(int(left[cursor]), space))
            else:
                cursor += 1
        if not space:
            windows.append(pieces)
            pieces, space = [], window


def pack(rows: DataFrame, window: int = WINDOW, shard_items: int = SHARD_ITEMS, lean: bool = False) -> DataFrame:
    """Pieces of the sequences from the items of items(), already partitioned and sorted.

    lean: a worker frees its memory of words first."""

    def run(batches):
        if lean:
            c.forget()
        sequence = (TaskContext.get().partitionId() << 40) - 1
        pool: list[tuple] = []

        def emit(windows):
            nonlocal sequence
            out = []
            for pieces in windows:
                sequence, offset = sequence + 1, 0
                for doc_id, first, total, ids in pieces:
                    out.append((doc_id, first, len(ids), crc(ids), total, sequence, offset))
                    offset += len(ids)
            return table(out)

        for batch in batches:
            full = []
            for kind, doc_id, first, length, code, total, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 0:
                    sequence += 1
                    full.append((doc_id, first, length, code, total, sequence, 0))
                else:
                    pool.append((doc_id, first, total, np.frombuffer(ids, f"<u{len(ids) // length}")))
            if full:
                yield table(full)
            while len(pool) >= shard_items:
                windows, rest = fill(pool[:shard_items], window)
                pool = rest + pool[shard_items:]
                yield emit(windows)
        if pool:
            windows, rest = fill(pool, window)
            yield emit(windows + powers_of_two(rest))

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [()] * 7)], [x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInArrow(run, PIECES)


def powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces in order, cut into sequences whose lengths are descending powers of two."""
    total = sum(len(x[3]) for x in pieces)
    out, queue = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        space, sequence = 1 << bit, []
        while space:
            doc_id, first, n, ids = queue.pop(0)
            take = min(space, len(ids))
            sequence.append((doc_id, first, n, ids[:take]))
            if take < len(ids):
                queue.insert(0, (doc_id, first + take, n, ids[take:]))
            space -= take
        out.append(sequence)
    return out


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, lean: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document.

    lean: workers remember fewer words, and none while they pack; the pieces are the same."""
    spark = docs.sparkSession
    rows = c.written(items(docs, path, window, LEAN_WORDS if lean else (CACHE, MET_ONCE)), "packing-items")
    ids = rows.agg(F.sum(F.when(F.col("kind") == 1, F.col("length")))).first()[0] or 0
    parts = max(1, -(-ids // PARTITION_IDS), min(c.parallelism(spark), -(-ids // (SHARD_ITEMS * 256))))
    dealt = rows.repartitionByRange(parts, "place", "doc_id", "start").sortWithinPartitions("place", "doc_id", "start")
    return pack(dealt, window, lean=lean)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(c.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
