"""N-gram Jaccard join: documents whose sets of five-word shingles reach a similarity of 0.75, and their components.

1. Shared shingles.  Every block of sets asks, part of the hash space by part, which of its shingles other sets have
   as well (four bytes to a shingle, never missing one).  A document with a partner shares at least 75 % of its set;
   the others are alone and done.
2. Classes.  Documents with equal sets are one class, represented by one text.  Asked again, classes learn how many
   have each of their shingles: those that share less than 75 % with other classes are done as well.
3. Candidates.  Shingles are put in one order, those of the fewest classes first.  Two sets with the similarity
   share one of the first n - ceil(0.75 n) + 1 of each, so passages that many texts share seldom bring others
   together.  Blocks of those hashes come together by hash, each set with a parity sketch of 512 bits: sketches
   of two sets differ in no more bits than the sets in shingles, so pairs of sets whose sketches differ in more than
   a link allows are no candidates.  The components of the candidate links are the places where all links lie.
4. T-occurrence search within a place.  In ascending size, each set is looked up in inverted lists of the
   groups found so far: the short lists are merged on a heap that skips (MergeSkip), the long ones are probed by
   binary search (DivideSkip).  A group that reaches the overlap a link needs is checked against its members,
   until one is exactly similar.  A place too large for a task is first compared with one of its sets, the
   pivot; the sets linked to it are one component, so only pairs of blocks with the other sets are searched.
5. The components of the links give each document the smallest doc_id of its component.

Words are separated by 0x20 and 0x09-0x0D, A-Z folded.  With fewer than five words the whole sequence is one
shingle; an empty or null text has none and is linked with nothing.  A null doc_id has a null component unless
it is linked to others; repeated rows are members of one class; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from . import graph, sketch

SHINGLE = 5
#: Similarity as a ratio of integers.
NEED, OF = 75, 100
#: Bytes of text to a task of the search; bytes and sets to a block of a large place; prefix hashes to a bucket.
TASK_BYTES, BLOCK_BYTES, BLOCK_SETS, BUCKET_HASHES, HELD = 6_000_000, 4_000_000, 4_000, 600_000, 500_000
#: Shingles to a part of the hash space and rows to a block of those that ask; what stands for no row; bits that tell a part's shingles apart.
PART_SHINGLES, BLOCK_ROWS, NO_ROW, LOW_BITS = 2_000_000, 32_000, 0xFFFF, 24
#: Counts of classes that have a shingle go up to this.
MOST = 255
#: 64-bit words of a parity sketch; sets of one prefix hash whose sketches are compared by neighbourhood, and one by one, at most.
SKETCH_WORDS, NEAR, ONE_BY_ONE = 8, 64, 30_000
#: Classes with a greater share of all rows than one in so many are joined by broadcast: at most so many.
HEAVY = 100_000
#: DivideSkip's constant for the number of long lists.
MU = 0.0085


def shingles(words: c.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) pairs sorted by text and hash."""
    h, at = words.windows(SHINGLE)
    text = words.text[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        few = np.array([c.roll(words.hash[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        h, text = np.concatenate([h, few]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def sets_of(column: pa.Array):
    """(first row, number of rows, edges, hashes) of blocks of a text column: row i has hashes[edges[i]:edges[i+1]]."""
    for first, n, raw, bounds in c.text_blocks(column):
        text, h = shingles(c.Words(raw, bounds, c.FOLDED_WORDS), n)
        yield first, n, np.searchsorted(text, np.arange(n + 1)), h


def least_shared(n: int) -> int:
    """Overlap that a set of n shingles has with any similar one, at least."""
    return -(-NEED * n // OF)


def set_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit digest of each text's set."""
    n, d1, d2 = (np.zeros(len(texts), np.int64) for _ in range(3))
    for first, rows, edges, h in sets_of(texts):
        for out, x in zip((n, d1, d2), digests(edges, h), strict=True):
            out[first : first + rows] = x
    return n, d1, d2


def digests(edges: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(edges)
    d1, d2 = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    some = np.flatnonzero(size)
    if len(some):
        for out, salt in ((d1, 0x1F83D9AB), (d2, 0x5BE0CD19)):
            out[some] = c.mix(np.add.reduceat(c.mix(h ^ np.uint64(salt)), edges[:-1][some]) + np.uint64(salt)).view(np.int64)
    return size, d1, d2


ASKED = "part int, block long, low binary, row binary, head binary"
ANSWERED = "block long, part int, low binary, row binary, count binary, head binary"


def ids_in_parts(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash above its LOW_BITS bits there.  That two shingles fall together does no more than raise a count."""
    part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return part << np.uint64(LOW_BITS) | h & np.uint64((1 << LOW_BITS) - 1)


def squeeze(low: np.ndarray) -> bytes:
    """Ascending values of 24 bits as their differences, byte by byte: the highest bytes are alike and compress."""
    return np.diff(low, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def expand(blob: bytes) -> np.ndarray:
    a, b, d = np.frombuffer(blob, np.uint8).reshape(3, -1).astype(np.int64)
    return np.cumsum(a | b << 8 | d << 16)


def block_messages(block: int, h: np.ndarray, row: np.ndarray, head: pa.Table, parts: int, most: int) -> pa.RecordBatch:
    """What a block of sets asks each part, and a message of its own: its rows, and the shingles it has `most` times by itself.

    Of such a shingle one entry without a row tells the part, so a frequent one sends no more than most - 1 entries a block."""
    ids = ids_in_parts(h, parts).view(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(ids)))
    own = np.repeat(count >= most, count)
    lead = np.zeros(len(ids), bool)
    lead[first] = True
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as out:
        out.write_table(head)
    rows = [(block % parts, c.packed(ids[own], "<i8"), row[own].tobytes(), sink.getvalue().to_pybytes())]
    asks = ~own | lead
    row[own] = NO_ROW
    ids, row = ids[asks], row[asks]
    edges = np.searchsorted(ids, np.arange(parts + 1) << LOW_BITS)
    for p in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[p], edges[p + 1]
        rows.append((p, squeeze(ids[a:b] & (1 << LOW_BITS) - 1), row[a:b].tobytes(), None))
    part, low, row, heads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([block] * len(part), pa.int64()), *(pa.array(x, pa.binary()) for x in (low, row, heads))], ["part", "block", "low", "row", "head"])


def answers(part: int, table: pa.Table, most: int, counted: bool) -> pa.Table:
    """The entries of one part that others have as well, to the blocks that asked; a block's own message as it is."""
    blocks = table.column("block").to_pylist()
    heads = table.column("head").to_pylist()
    lows, rows = table.column("low").to_pylist(), table.column("row").to_pylist()
    total = np.zeros(1 << LOW_BITS, np.uint8)
    out = []
    asked = []
    for block, low, row, head in zip(blocks, lows, rows, heads, strict=True):
        if head is not None:
            out.append((block, -1, low, row, None, head))
            continue
        low, row = expand(low).astype(np.int32), np.frombuffer(row, "<u2")
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        more = np.where(row[first] == NO_ROW, most, np.diff(np.append(first, len(low))))
        at = low[first]
        total[at] = np.minimum(total[at] + more, most)
        asked.append((block, low, row))
    for block, low, row in asked:
        count = total[low]
        shared = (count > 1) & (row != NO_ROW)
        if shared.any():
            out.append((block, part, squeeze(low[shared]) if counted else None, row[shared].tobytes(), count[shared].tobytes() if counted else None, None))
    block, part_of, low, row, count, head = zip(*out, strict=True) if out else ((),) * 6
    return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array(part_of, pa.int32()), **{k: pa.array(x, pa.binary()) for k, x in (("low", low), ("row", row), ("count", count), ("head", head))}})


def shared_shingles(rows: DataFrame, head, parts: int, most: int, then, schema: str) -> DataFrame:
    """then(head, row, id, count) for each block of rows, whose last column is a text: its shingles that occur twice or more.

    head: from a batch of rows, their edges and hashes to a table with a row for each.  id and count are None where
    most is 2.  The shingles of a block go to the parts of the hash space they fall in, and what a part knows of them comes
    back, so no task holds more than a block or a part, whatever the corpus."""
    counted = most > 2

    def ask(batches):
        c.forget()
        number = TaskContext.get().partitionId() << 32
        held, heads, n, total = [], [], 0, 0

        def send():
            h, row = (np.concatenate(x) for x in zip(*held, strict=True))
            return block_messages(number, h, row, pa.concat_tables(heads), parts, most)

        for batch in batches:
            for first, k, edges, h in sets_of(batch.column(batch.num_columns - 1)):
                held.append((h, np.repeat(np.arange(n, n + k, dtype="<u2"), np.diff(edges))))
                heads.append(head(batch.slice(first, k), edges, h))
                n, total = n + k, total + len(h)
                if total >= HELD or n >= BLOCK_ROWS:
                    yield send()
                    held, heads, n, total, number = [], [], 0, 0, number + 1
        if held:
            yield send()

    def answer(key, table):
        return answers(key[0].as_py(), table, most, counted)

    def gather(table):
        heads = table.column("head").to_pylist()
        own = next(i for i, x in enumerate(heads) if x is not None)
        known = table.column("row").to_pylist()
        row = c.joined(known, "<u2").astype(np.int64)
        ids = count = None
        if counted:
            ids, count = [], []
            for i, (part, low, n) in enumerate(zip(table.column("part").to_pylist(), table.column("low").to_pylist(), table.column("count").to_pylist(), strict=True)):
                ids.append(np.frombuffer(low, "<i8") if i == own else expand(low) + (part << LOW_BITS))
                count.append(np.full(len(ids[-1]), most, np.int64) if i == own else np.frombuffer(n, np.uint8).astype(np.int64))
            ids, count = np.concatenate(ids), np.concatenate(count)
        return then(pa.ipc.open_stream(heads[own]).read_all(), row, ids, count)

    messages = rows.mapInArrow(ask, ASKED).groupBy("part").applyInArrow(answer, ANSWERED)
    return messages.groupBy("block").applyInArrow(gather, schema)


def parts_for(spark: SparkSession, chars: int) -> int:
    """Parts of the hash space: some six characters to a shingle."""
    return max(c.parallelism(spark), -(-chars // 6 // PART_SHINGLES))


BASE = "doc_id long, n_shingles long, d1 long, d2 long, key long, known boolean"


def measured(docs: DataFrame, parts: int) -> DataFrame:
    """Every row's set size and digest, a hash of its text, and whether it shares enough to have a partner."""

    def head(batch, edges, h):
        return pa.table({"doc_id": batch.column(0).cast(pa.int64()), **dict(zip(("n_shingles", "d1", "d2"), map(pa.array, digests(edges, h)), strict=True)), "key": batch.column(1)})

    def then(rows, row, ids, count):
        size = rows.column("n_shingles").to_numpy()
        known = np.bincount(row, minlength=len(size))
        return rows.append_column("known", pa.array((size > 0) & (OF * known >= NEED * size)))

    return shared_shingles(docs.select("doc_id", F.xxhash64("text").alias("key"), "text"), head, parts, 2, then, BASE)


def one_of(keys: DataFrame, n: int) -> sketch.Repeated:
    """Whether a 64-bit value may be among those of a column: never a missed one.  Eight bits to each of n, within the sketch's bounds."""
    bits = sketch.width_bits(n)

    def run(batches):
        for batch in batches:
            if batch.num_rows:  # every value counts twice
                yield sketch.partition_rows(np.repeat(batch.column(0).to_numpy().view(np.uint64), 2), bits, 1)

    return sketch.collect(keys.mapInArrow(run, sketch.PARTS), bits, 1)


def texts_of(docs: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """classes with a text of each.

    Only texts that could be a class's move."""
    keys = known.select("key")
    may = docs.sparkSession.sparkContext.broadcast(one_of(keys, keys.count()))

    def run(batches):
        for batch in batches:
            text = batch.column(1).filter(pa.array(may.value(batch.column(0).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([*map(pa.array, set_digests(text)[1:]), text], ["d1", "d2", "text"])

    texts = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(run, "d1 long, d2 long, text string")
    return texts.groupBy("d1", "d2").agg(F.first("text").alias("text")).join(classes, ["d1", "d2"])


BLOCK = "part int, h binary, node binary, size binary, sketch binary"


def parity(edges: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each set a bit for the parity of the number of its shingles that fall on it."""
    n, bits = len(edges) - 1, 64 * SKETCH_WORDS
    cell = (c.mix(h ^ np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(edges)) * bits + cell, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view("<u8")


def prefix_blocks(classes: DataFrame, asked: int, parts: int) -> DataFrame:
    """Blocks of (hash, node, set size, sketch) of the prefixes of the sets that share enough with other classes, by hash.

    asked: the parts of the hash space that count the classes of each shingle."""

    def head(batch, edges, h):
        bits = parity(edges, h)
        return pa.table({"node": batch.column(0), "n": pa.array(np.diff(edges)), "sketch": pa.array([x.tobytes() for x in bits], pa.binary())})

    def then(rows, row, ids, count):
        node, size = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        known = np.bincount(row, minlength=len(size))
        enough = (size > 0) & (OF * known >= NEED * size)
        # shingles of one class come first and lead to no other
        length = np.where(enough, size - -(-NEED * size // OF) + 1 - (size - known), 0)
        order = np.lexsort((ids, count, row))
        ids, row = ids[order], row[order]
        place = np.arange(len(row)) - np.repeat(np.cumsum(known) - known, known)
        pick = place < length[row]
        h, owner = c.mix(ids[pick].astype(np.uint64)), row[pick]
        bits = c.joined(rows.column("sketch").to_pylist(), "<u8").reshape(-1, SKETCH_WORDS)[owner]
        at = list(c.split_by((h % np.uint64(parts)).astype(np.int64), parts))
        return pa.table({"part": pa.array([p for p, _ in at], pa.int32()), **{k: pa.array([c.packed(x[r], kind) for _, r in at], pa.binary()) for k, x, kind in (("h", h, "<u8"), ("node", node[owner], "<i8"), ("size", size[owner], "<i4"), ("sketch", bits, "<u8"))}})

    return shared_shingles(classes.select("node", "text"), head, asked, MOST, then, BLOCK)


def may_be_similar(size_a, bits_a, size_b, bits_b) -> np.ndarray:
    """Whether sizes and sketches allow a link: |A xor B| <= (OF - NEED) / (OF + NEED) * (|A| + |B|)."""
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    return (OF * least >= NEED * most) & ((OF + NEED) * differ <= (OF - NEED) * (least + most))


def connect(node: np.ndarray, size: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what candidate pairs of one prefix hash connect: breadth first, each set once against those not met yet."""
    out, left = [], np.arange(len(node))
    while len(left):
        queue, left = [left[0]], left[1:]
        for i in queue:
            if not len(left):
                break
            hit = may_be_similar(size[i], bits[i], size[left], bits[left])
            out += [(int(node[i]), int(node[j])) for j in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return out


def candidate_links(blocks: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets which share a prefix hash and could be similar by sizes and sketches."""

    def link(table):
        h, node, size, bits = (c.joined(table.column(f).to_pylist(), k) for f, k in (("h", "<u8"), ("node", "<i8"), ("size", "<i4"), ("sketch", "<u8")))
        order = np.lexsort((node, size, h))
        h, node, size, bits = h[order], node[order], size[order].astype(np.int64), bits.reshape(-1, SKETCH_WORDS)[order]
        pairs = [np.zeros((0, 2), np.int64)]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        many = count > NEAR
        for a, n in zip(first[many].tolist(), count[many].tolist(), strict=True):
            part = slice(a, a + n)
            if n <= ONE_BY_ONE:
                found = connect(node[part], size[part], bits[part])
            else:  # neighbours by size connect whatever could be similar
                near = np.flatnonzero(OF * size[part][:-1] >= NEED * size[part][1:])
                found = np.stack([node[part][near], node[part][near + 1]], axis=1)
            pairs.append(np.array(found, np.int64).reshape(-1, 2))
        at = np.flatnonzero(~np.repeat(many, count)) if len(h) else first
        end = np.repeat(first + count, count)[at]
        for step in range(1, NEAR):
            keep = at + step < end
            at, end = at[keep], end[keep]
            keep = OF * size[at] >= NEED * size[at + step]  # later ones are larger still
            at, end = at[keep], end[keep]
            if not len(at):
                break
            hit = at[may_be_similar(size[at], bits[at], size[at + step], bits[at + step])]
            pairs.append(np.stack([node[hit], node[hit + step]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return blocks.groupBy("part").applyInArrow(link, "a long, b long").distinct()


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """Values that occur in `need` of the sorted lists or more, with their counts, by a heap that skips."""
    heap = [(values[0], i) for i, values in enumerate(lists)]
    heapify(heap)
    at = [0] * len(lists)
    found = []
    while len(heap) >= need:
        value = heap[0][0]
        popped = []
        while heap and heap[0][0] == value:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            found.append((value, len(popped)))
            target = value + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                break
            target = max(heap[0][0], value + 1)
        for i in popped:
            values = lists[i]
            j = at[i] = bisect_left(values, target, at[i])
            if j < len(values):
                heappush(heap, (values[j], i))
    return found


def t_occurrences(lists: list[list[int]], need: int) -> list[int]:
    """Values in `need` or more of the lists: DivideSkip."""
    if len(lists) < need:
        return []
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    n_long = min(need - 1, int(need / (MU * log2(longest) + 1)) if longest > 1 else need - 1)
    short, long = (lists[: len(lists) - n_long], lists[len(lists) - n_long :]) if n_long else (lists, [])
    out = []
    for value, count in merge_skip(short, need - n_long):
        left = len(long)
        for values in long:
            if count >= need or count + left < need:
                break
            left -= 1
            j = bisect_left(values, value)
            count += j < len(values) and values[j] == value
        if count >= need:
            out.append(value)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if OF * len(a) < NEED * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return OF * both >= NEED * (len(a) + len(b) - both)


def links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of exactly similar sets that connect all that similar pairs connect."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    index: dict[int, list[int]] = {}
    members: list[list[int]] = []  # of each group
    parent: list[int] = []
    out = []

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    for i in order:
        hashes = sets[i].tolist()
        if not hashes:
            continue
        found = t_occurrences([index[h] for h in hashes if h in index], least_shared(len(hashes)))
        own = None
        for g in found:
            if own is not None and root(g) == root(own):
                continue
            partner = next((j for j in reversed(members[g]) if similar(sets[j], sets[i])), None)
            if partner is None:
                continue
            out.append((nodes[partner], nodes[i]))
            if own is None:
                own = g
            else:
                parent[root(g)] = root(own)
        if own is None:
            own = len(members)
            members.append([])
            parent.append(own)
        members[own].append(i)
        for h in hashes:
            values = index.setdefault(h, [])
            j = bisect_left(values, own)
            if j == len(values) or values[j] != own:
                values.insert(j, own)
    return out


def search(placed: DataFrame, tasks: int) -> DataFrame:
    """Links within each place of each task's rows (task, place, node, text).

    As many partitions as tasks: by size, adaptive execution would join small partitions of long work."""

    def run(table):
        places = table.column("place").to_numpy()
        nodes = table.column("node").to_numpy()
        sets: list[np.ndarray] = []
        for _, n, edges, h in sets_of(table.column("text")):
            sets += [h[edges[i] : edges[i + 1]] for i in range(n)]
        out = []
        order = np.argsort(places, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(places[order])) + 1):
            out += links([int(nodes[i]) for i in rows], [sets[i] for i in rows])
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.repartition(tasks, "task").groupBy("task").applyInArrow(run, "a long, b long")


def pivot_links(rows: DataFrame) -> DataFrame:
    """Rows (place, node, text, pivot, pivot_text) with linked: whether the set is similar to its place's pivot."""
    import pandas as pd

    @F.pandas_udf("boolean")
    def is_similar(text, pivot):
        known: dict[str, np.ndarray] = {}
        out = []
        for _, n, edges, h in sets_of(pa.array(text, pa.string(), from_pandas=True)):
            for i in range(n):
                other = pivot.iloc[len(out)]
                if other not in known:
                    known.clear()
                    known[other] = next(h for _, _, _, h in sets_of(pa.array([other], pa.string())))
                out.append(similar(h[edges[i] : edges[i + 1]], known[other]))
        return pd.Series(out, dtype=bool)

    return rows.withColumn("linked", is_similar("text", "pivot_text"))


def placed(classes: DataFrame, places: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Rows of the search, the number of its tasks, and the links to pivots.

    Small places share tasks.  In a large one, blocks of sets that aren't linked to the pivot meet each block."""
    rows = classes.join(places, "node").select("node", "text", F.col("component").alias("place"))
    sizes = rows.groupBy("place").agg(F.sum(F.length("text")).alias("bytes"), F.count("*").alias("n"), F.min("node").alias("pivot"))
    sizes = sizes.withColumn("large", (F.col("bytes") > BLOCK_BYTES) | (F.col("n") > BLOCK_SETS)).withColumnRenamed("place", "p")
    rows = c.written(rows.join(sizes, F.col("place") == F.col("p")).drop("p"), "jaccard-places")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    small = rows.where(~F.col("large")).select(F.pmod(F.xxhash64("place"), F.lit(tasks)).alias("task"), "place", "node", "text")
    large = rows.where("large")
    pivots = large.where("node = pivot").select(F.col("place").alias("p"), F.col("text").alias("pivot_text"))
    large = pivot_links(large.join(pivots, F.col("place") == F.col("p")).drop("p")).drop("pivot_text")
    large = c.written(large, "jaccard-large")
    found = large.where("linked AND node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(F.length("text")) / BLOCK_BYTES, F.count("*") / BLOCK_SETS))).cast("int")
    counts = large.groupBy("place").agg(
        F.sum(F.when(F.col("linked"), 1).otherwise(0)).alias("n_linked"),
        F.sum(F.when(~F.col("linked"), 1).otherwise(0)).alias("n_others"),
        blocks.alias("blocks"),
    )
    share = F.col("blocks") / (F.col("n_linked") + F.col("n_others"))
    counts = counts.select(F.col("place").alias("p"), F.ceil(F.col("n_linked") * share).cast("int").alias("b_linked"), F.ceil(F.col("n_others") * share).cast("int").alias("b_others")).where("b_others > 0")
    pairs = counts.agg(F.sum(F.col("b_others") * F.col("b_linked") + F.col("b_others") * (F.col("b_others") + 1) / 2)).first()[0] or 0
    large = large.join(counts, F.col("place") == F.col("p"))
    block = F.when(F.col("linked"), F.pmod(F.xxhash64("node"), F.col("b_linked"))).otherwise(F.col("b_linked") + F.pmod(F.xxhash64("node"), F.col("b_others"))).cast("int")
    large = large.withColumn("block", block)
    first = F.when(F.col("linked"), F.col("b_linked")).otherwise(F.lit(0))
    met = F.sequence(first, F.col("b_linked") + F.col("b_others") - 1)
    met = F.when(F.col("b_linked") + F.col("b_others") == 1, met).otherwise(F.filter(met, lambda x: x != F.col("block")))
    large = large.withColumn("other", F.explode(met))
    task = F.xxhash64("place", F.least("block", "other"), F.greatest("block", "other"))
    return small.unionByName(large.select(task.alias("task"), "place", "node", "text")), tasks + int(pairs), found


def members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """base, a written row for each row of docs: doc_id, n_shingles, d1, d2, key, known; and the known classes: d1, d2, n rows,
    component (null without links), component_id."""
    spark = docs.sparkSession
    c.small_batches(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    base = c.written(measured(docs, parts_for(spark, chars)), "jaccard-base")
    c.release(spark)
    known = base.where("known")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    # written once, so the numbers stay; a hash of 64 bits might name two classes alike
    classes = c.written(texts_of(docs, known, classes).withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    c.release(spark)
    chars = classes.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(c.parallelism(spark), -(-chars // 24 // BUCKET_HASHES))
    places = graph.components(candidate_links(prefix_blocks(classes, parts_for(spark, chars), parts)))
    c.release(spark)
    rows, tasks, found = placed(classes, places)
    found = graph.components(search(rows, tasks).unionByName(found))
    c.release(spark)
    parts_of = classes.select("node", "least").join(found, "node")
    least = parts_of.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = classes.select("node", "d1", "d2", "n", "least").join(parts_of.join(least, "component").select("node", "component", "component_id"), "node", "left")
    ids = ids.select("d1", "d2", "n", "component", F.coalesce("component_id", "least").alias("component_id"))
    return base, c.written(ids, "jaccard-ids")


def with_classes(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of base with their class's component and component_id.

    The rows of a class that has more than its share meet it by broadcast, so none of them is gathered by class."""
    total = base.count()
    ids = ids.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "n", "component", "component_id")
    same = (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))
    heavy = ids.where(F.col("n") * HEAVY > total).drop("n")  # fewer than HEAVY
    light = ids.where(F.col("n") * HEAVY <= total).drop("n")
    hit = base.where("known").join(F.broadcast(heavy), same, "left")
    done = hit.where(F.col("c1").isNotNull())
    rest = hit.where(F.col("c1").isNull()).select(*base.columns).join(light, same, "left")
    alone = base.where("NOT known").withColumns({"c1": F.lit(None).cast("long"), "c2": F.lit(None).cast("long"), "component": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    return done.unionByName(rest).unionByName(alone).drop("c1", "c2")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return with_classes(*members(docs)).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest by doc_id, set and other columns; null ids and texts without words stay.

    Rows of one doc_id are told apart by their sets, so of unlike ones each stays that is the smallest of its component."""
    base, ids = members(docs.select("doc_id", "text"))
    rows = c.written(with_classes(base, ids).where("doc_id IS NOT NULL AND n_shingles > 0"), "jaccard-rows")
    # a component is named by its node, else by its set (a class without links, or a text that none shares enough with)
    key = [F.coalesce("component", F.lit(-1)).alias("k0"), F.when(F.col("component").isNull(), F.col("d1")).alias("k1"), F.when(F.col("component").isNull(), F.col("d2")).alias("k2")]
    sets = rows.groupBy("doc_id", "d1", "d2", *key).agg(F.count("*").alias("m"))
    keep = sets.groupBy("k0", "k1", "k2").agg(F.min(F.struct("doc_id", "d1", "d2", "m")).alias("x")).select("x.*")
    keep = c.written(keep, "jaccard-keep")
    spark = docs.sparkSession
    # rows that go, or of which one of several stays; texts of others needn't move
    doubtful = rows.join(keep.where("m = 1"), ["doc_id", "d1", "d2"], "left_anti").select(F.xxhash64("doc_id", "key").alias("key"))
    may = spark.sparkContext.broadcast(one_of(doubtful, doubtful.count()))
    c.small_batches(spark)
    names = [F.col(f"`{x}`") for x in docs.columns]

    @F.arrow_udf("boolean")
    def in_doubt(key: pa.Array) -> pa.Array:
        return pa.array(may.value(key.to_numpy(zero_copy_only=False).view(np.uint64)))

    @F.arrow_udf("struct<n:long,d1:long,d2:long>")
    def digest(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(list(map(pa.array, set_digests(text))), ["n", "d1", "d2"])

    known = docs.where(F.col("doc_id").isNotNull())
    doubt = in_doubt(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    rest = known.where(doubt).withColumn("__df_set", digest("text"))
    keep = keep.select(F.col("doc_id").alias("__df_id"), F.col("d1").alias("__df_d1"), F.col("d2").alias("__df_d2"))
    some = rest.join(keep, (F.col("doc_id") == F.col("__df_id")) & (F.col("__df_set.d1") == F.col("__df_d1")) & (F.col("__df_set.d2") == F.col("__df_d2")), "left_semi").where("__df_set.n > 0")
    # of rows with one id and set, one
    order = Window.partitionBy("doc_id", "__df_set").orderBy(*(F.col(f"`{x}`") for x in docs.columns if x != "doc_id"))
    some = some.withColumn("__df_place", F.row_number().over(order)).where("__df_place = 1")
    out = known.where(~doubt).select(*names).unionByName(some.select(*names)).unionByName(rest.where("__df_set.n = 0").select(*names))
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(c.documents(spark, sf_dir))
