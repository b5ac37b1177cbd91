"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, over exact counts.

1. Counts of all words of all training texts, by blocks of hash ranges (no word list on the driver).
2. Frequent words get a code of three digits to the base 16: a group of words that follow the same frequent words, a
   frequency bin of the group, and a bin of that bin.  All other words are the group 15.  Group and bins are the
   class of a word; its last digit is the trained factor of the word within its class.  The code of a word depends
   on its hash alone, so the model is normalised.
3. P(digit | history, digits before) is a softmax over hashed features: the previous word, the word before it (a skip),
   and both, each with the digits before.  The number of hashed rows grows with the training tokens.
4. Distributed gradient updates: the training texts are dealt into ``SLICES`` by hash.  The counts of the first slice
   give the first weights; each of the others gives one update, so every training token is used.  Partitions sum
   the gradient of their tokens; the sums are added in two steps and update the weights with steps scaled by the curvature.
5. P(word | code) comes from the counts.  Scoring reads texts in array batches.  Counts of frequent words are
   broadcast (a bounded table); the others' are met by hash range: a text's rare words go to the counts, as
   blocks, and their sums return to the text's row.

Words are separated by 0x20 and 0x09-0x0D, A-Z folded; each text ends with one end token.  A null or empty
text is the end token alone; a null doc_id counts as empty text in the fold and is learned from; repeated rows
are counted and scored each; extra columns are ignored; with no training text all counts are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Words whose counts are broadcast, at most; those with a code of their own; contexts that make groups.
FREQUENT, GROUPED, CONTEXTS = 1 << 19, 1 << 16, 128
#: Digits of a code, its base, the group of all other words, feature kinds.
LEVELS, BASE, OTHERS, KINDS = 3, 16, 15, 3
#: log2 of the hashed rows of a level and kind: of the training tokens, less so many, within bounds.
ROW_BITS, LEAST_BITS, MOST_BITS = 13, 12, 17
#: Slices of the training texts; prior weight of a row; the step of the first weights and of the updates.
SLICES, PRIOR, FIRST_STEP, STEP = 6, 20.0, 0.45, 0.5
#: Rows to a part of the sums; characters to a task of an update with the fewest rows; parts that a task adds, at most.
PART_ROWS, TASK_CHARS, FAN_IN = 1 << 11, 3_000_000, 16
HELD = 4_000_000
BUCKET_CHARS = 12_000_000
END, BEGIN = np.uint64(0x7E2F6B1D9C3A5E01), np.uint64(0x3D1C5A7E9B2F4C03)


class Tokens:
    """Token hashes of a block of texts, the end tokens among them, and the text of each."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        words = c.Words(raw, bounds, c.FOLDED_WORDS)
        n = len(bounds) - 1
        self.n = n
        counts = np.diff(words.first) + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.hash = np.empty(self.first[-1], np.uint64)
        last = self.first[1:] - 1
        self.hash[last] = END
        inner = np.ones(len(self.hash), bool)
        inner[last] = False
        self.hash[inner] = words.hash
        self.text = np.repeat(np.arange(n), counts)

    def histories(self) -> tuple[np.ndarray, np.ndarray]:
        """The previous token and the one before it."""
        one, two = np.empty_like(self.hash), np.empty_like(self.hash)
        one[1:], two[2:] = self.hash[:-1], self.hash[:-2]
        one[self.first[:-1]] = BEGIN
        second = self.first[:-1] + 1
        two[second[second < self.first[1:]]] = BEGIN
        two[self.first[:-1]] = BEGIN
        return one, two

    def features(self) -> tuple[np.ndarray, ...]:
        """A hash for each feature kind."""
        one, two = self.histories()
        return one, c.mix(two ^ np.uint64(0x94D049BB133111EB)), c.mix(one * np.uint64(0xFF51AFD7ED558CCD) + two)


def sums_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def range_blocks(keys: np.ndarray, columns: dict, parts: int, kind: int) -> list[tuple]:
    return [(part, kind, {k: v[rows] for k, v in columns.items()}) for part, rows in c.split_by((keys % np.uint64(parts)).astype(np.int64), parts)]


def training(docs: DataFrame) -> DataFrame:
    return docs.where(c.crc_of_id() % 10 != 0).select("text")


def blocks_of(batches, column: int = 0):
    for batch in batches:
        for first, n, raw, bounds in c.text_blocks(batch.column(column)):
            yield batch, first, n, Tokens(raw, bounds)


# ---- counts

COUNTS = "part int, h binary, n binary, words long, tokens long, above array<long>"


def count_words(train: DataFrame, parts: int) -> DataFrame:
    """A row for each hash range: its words in order, their counts, and how many have a count of 2^j or more."""

    def send(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        rows = range_blocks(h, {"h": h, "n": n}, parts, 0)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([c.packed(r[2]["h"], "<u8") for r in rows], pa.binary()), pa.array([c.packed(r[2]["n"], "<i8") for r in rows], pa.binary())], ["part", "h", "n"])

    def run(batches):
        c.forget()
        held, total = [], 0
        for _, _, _, tokens in blocks_of(batches):
            held.append(tokens.hash)
            total += len(tokens.hash)
            if total >= HELD:
                yield send(held)
                held, total = [], 0
        if held:
            yield send(held)

    def add(key, table):
        h, n = sums_by_key(c.joined(table.column("h").to_pylist(), "<u8"), c.joined(table.column("n").to_pylist(), "<i8"))
        above = [int((n >= 1 << j).sum()) for j in range(48)]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "h": pa.array([c.packed(h, "<u8")], pa.binary()), "n": pa.array([c.packed(n, "<i8")], pa.binary()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "above": pa.array([above], pa.list_(pa.int64()))})

    return train.mapInArrow(run, "part int, h binary, n binary").groupBy("part").applyInArrow(add, COUNTS)


class Vocabulary:
    """Frequent words: hashes in order, counts, classes; totals of all words and of each class."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, words: int, tokens: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.words, self.tokens = words, tokens
        self.rank = np.empty(len(order), np.int64)  # 0: the most frequent
        self.rank[np.lexsort((self.hashes, -self.counts))] = np.arange(len(order))
        self.assign(np.zeros(0, np.int64))

    def assign(self, groups: np.ndarray) -> None:
        """groups: a group below OTHERS for each rank below GROUPED; -1: none.

        A group's words are cut into bins of about the same mass, each of which is cut once more; -1 is the code of others."""
        self.codes = np.full(len(self.hashes), -1, np.int32)
        by_rank = np.argsort(self.rank)[: len(groups)]
        mass = np.sqrt(self.counts[by_rank].astype(float))

        def bins(m: np.ndarray) -> np.ndarray:
            total = np.cumsum(m)
            return np.minimum(BASE - 1, (BASE * (total - m / 2) / total[-1]).astype(np.int64))

        for g in range(OTHERS):
            own = np.flatnonzero(groups == g)
            if not len(own):
                continue
            second = bins(mass[own])
            for d in np.unique(second):
                part = own[second == d]
                self.codes[by_rank[part]] = (g * BASE + d) * BASE + bins(mass[part])
        leaves = OTHERS * BASE * BASE + 1  # the last: others
        leaf = np.where(self.codes >= 0, self.codes, leaves - 1)
        words = np.bincount(leaf, minlength=leaves).astype(float)
        tokens = np.bincount(leaf, self.counts, leaves)
        words[-1] += self.words - len(self.hashes) + 1  # one for words never met
        tokens[-1] += self.tokens - self.counts.sum()
        self.leaf_words, self.leaf_tokens = words, tokens

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it isn't frequent."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1)

    def code_of(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.codes[at] if len(self.codes) else -1, -1)

    def biases(self) -> list[np.ndarray]:
        """For each level the log shares of a digit after the digits before; a digit that no word has gets nothing."""

        def tables(leaves: np.ndarray) -> list[np.ndarray]:
            own = leaves[:-1].reshape(OTHERS, BASE, BASE)
            return [np.append(own.sum((1, 2)), leaves[-1])[None, :], own.sum(2), own.reshape(-1, BASE)]

        out = []
        for words, tokens in zip(tables(self.leaf_words), tables(self.leaf_tokens), strict=True):
            mass = np.where(words > 0, tokens + 0.1, 0)
            out.append(np.where(words > 0, np.log((mass + 1e-30) / np.maximum(mass.sum(1, keepdims=True), 1e-30)), -1e4).astype(np.float32))
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals, and the words from the lowest power of two of counts that FREQUENT words reach."""
    above = [F.sum(F.col("above")[j]).alias(f"a{j}") for j in range(48)]
    row = counts.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), *above).first()
    least = next((1 << j for j in range(48) if (row[f"a{j}"] or 0) <= FREQUENT), 1 << 48)

    def pick(batches):
        for batch in batches:
            out = []
            for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = np.frombuffer(h, "<u8"), np.frombuffer(n, "<i8")
                out.append((h[n >= least].tobytes(), n[n >= least].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["h", "n"])

    got = counts.select("h", "n").mapInArrow(pick, "h binary, n binary").toArrow()
    h, n = (c.joined(got.column(x).to_pylist(), k) for x, k in (("h", "<u8"), ("n", "<i8")))
    return Vocabulary(h, n, row["words"] or 0, row["tokens"] or 0)


# ---- codes


def added(parts: DataFrame, add, schema: str) -> DataFrame:
    """Blocks of a part added to one: where many partitions send some, in groups of partitions first."""
    groups = -(-parts.rdd.getNumPartitions() // FAN_IN)  # the scan's; nothing runs
    if groups > 1:
        parts = parts.withColumn("grp", F.spark_partition_id() % groups).groupBy("part", "grp").applyInArrow(add, schema)
    return parts.groupBy("part").applyInArrow(add, schema)


def group_words(train: DataFrame, known: Vocabulary) -> np.ndarray:
    """Groups of the most frequent words by the frequent words they follow."""
    n = min(GROUPED, len(known.hashes))
    contexts = min(CONTEXTS, n)
    if not n:
        return np.zeros(0, np.int64)
    shared = train.sparkSession.sparkContext.broadcast((known.hashes, known.rank))

    def run(batches):
        c.forget()
        hashes, rank = shared.value
        held, total = [], 0

        def send():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            slices = keys // (CONTEXTS * 1024)
            edges = np.searchsorted(slices, np.arange(-(-GROUPED // 1024) + 1))
            parts = [(s, keys[a:b], counts[a:b]) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([c.packed(p[1], "<i8") for p in parts], pa.binary()), pa.array([c.packed(p[2], "<i8") for p in parts], pa.binary())], ["part", "k", "n"])

        for _, _, _, tokens in blocks_of(batches):
            at = np.searchsorted(hashes, tokens.hash)
            at[at == len(hashes)] = 0
            place = np.where(hashes[at] == tokens.hash, rank[at], 1 << 40)
            one, word = place[:-1], place[1:]
            keep = (one < contexts) & (word < n) & (tokens.text[1:] == tokens.text[:-1])
            held.append(word[keep] * CONTEXTS + one[keep])
            total += len(held[-1])
            if total >= HELD:
                yield send()
                held, total = [], 0
        if held:
            yield send()

    def add(key, table):
        k, v = sums_by_key(c.joined(table.column("k").to_pylist(), "<i8"), c.joined(table.column("n").to_pylist(), "<i8"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "k": pa.array([c.packed(k, "<i8")], pa.binary()), "n": pa.array([c.packed(v, "<i8")], pa.binary())})

    got = added(train.mapInArrow(run, "part int, k binary, n binary"), add, "part int, k binary, n binary").toArrow()
    k, v = (c.joined(got.column(x).to_pylist(), "<i8") for x in ("k", "n"))
    table = np.zeros((n, contexts), np.float32)
    table[k // CONTEXTS, k % CONTEXTS] = v
    return spherical_groups(table)


def spherical_groups(table: np.ndarray, rounds: int = 15) -> np.ndarray:
    """k-means by cosine over the rows' square roots, from rows far from each other; -1 for empty rows."""
    rows = np.sqrt(table)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    some = norm[:, 0] > 0
    rows = rows / np.maximum(norm, 1e-9)
    weight = table.sum(1)
    heavy = np.flatnonzero(some)[np.argsort(-weight[some], kind="stable")][:4000]
    if len(heavy) < OTHERS:
        return np.where(some, 0, -1)
    sample, mass = rows[heavy], weight[heavy, None]
    centres = [sample[0]]
    for _ in range(OTHERS - 1):
        centres.append(sample[int(np.argmin((sample @ np.array(centres).T).max(1) - 1e-6 * np.log1p(mass[:, 0])))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        for g in range(OTHERS):
            if (own == g).any():
                centre = (sample[own == g] * mass[own == g]).sum(0)
                centres[g] = centre / max(float(np.linalg.norm(centre)), 1e-9)
    return np.where(some, (rows @ centres.T).argmax(1), -1)


# ---- gradient


def digits_of(code: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
    """For each level: the tokens that have such a digit, the digits before as a number, and the digit."""
    own = np.flatnonzero(code >= 0)
    some = code[own]
    return [(slice(None), np.zeros(len(code), np.int64), np.where(code >= 0, code >> 8, OTHERS)), (own, some >> 8, some >> 4 & 15), (own, some >> 4, some & 15)]


def rows_of(features: tuple[np.ndarray, ...], level: int, which, before: np.ndarray, bits: int) -> list[np.ndarray]:
    """The hashed row of each feature kind with the digits before."""
    if level:
        salt = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)
        features = [(f[which] ^ salt) * np.uint64(0xD6E8FEB86659FD93) for f in features]
    shift = np.uint64(64 - bits)
    return [(f >> shift).astype(np.int64) for f in features]


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Model:
    """weights: LEVELS x KINDS x rows x BASE; biases by level."""

    def __init__(self, known: Vocabulary, bits: int):
        self.known, self.bits = known, bits
        self.weights = np.zeros((LEVELS, KINDS, 1 << bits, BASE), np.float32)
        self.bias = known.biases()

    def levels(self, tokens: Tokens, code: np.ndarray):
        """For each level: tokens, rows by kind, digit, and the log probabilities of all digits."""
        features = tokens.features()
        for level, (which, before, digit) in enumerate(digits_of(code)):
            rows = rows_of(features, level, which, before, self.bits)
            z = self.bias[level][before]
            for k in range(KINDS):
                z = z + self.weights[level, k][rows[k]]
            yield level, which, rows, digit, log_softmax(z)

    def log_probabilities(self, tokens: Tokens, code: np.ndarray) -> np.ndarray:
        """The log probability of each token's code after its history."""
        out = np.zeros(len(code))
        for _, which, _, digit, log_p in self.levels(tokens, code):
            out[which] += log_p[np.arange(len(digit)), digit]
        return out


def row_sums(rows: np.ndarray, values: np.ndarray, total: np.ndarray) -> None:
    """Adds each value (a vector) to its row of the total."""
    order = np.argsort(rows.astype(np.uint16) if len(total) <= 1 << 16 else rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    if len(first):
        total[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def block_gradient(model: Model, tokens: Tokens, total: np.ndarray) -> None:
    """Adds what the tokens have of each digit, less what the model expects, to their rows."""
    code = model.known.code_of(model.known.find(tokens.hash))
    for level, _, rows, digit, log_p in model.levels(tokens, code):
        error = -np.exp(log_p)
        error[np.arange(len(digit)), digit] += 1
        for k in range(KINDS):
            row_sums(rows[k], error, total[level, k])


def block_counts(model: Model, tokens: Tokens, total: np.ndarray) -> None:
    """Adds what the tokens have of each digit, and what the biases expect, to their rows: total[0] and total[1]."""
    code = model.known.code_of(model.known.find(tokens.hash))
    n = 1 << model.bits
    for level, (which, before, digit) in enumerate(digits_of(code)):
        share = np.exp(model.bias[level])[before]
        for k, rows in enumerate(rows_of(tokens.features(), level, which, before, model.bits)):
            total[0, level, k] += np.bincount(rows * BASE + digit, minlength=n * BASE).reshape(n, BASE)
            row_sums(rows, share, total[1, level, k])


def slice_sums(train: DataFrame, number: int, model: Model, chars: int, counts: bool) -> np.ndarray:
    """The sums of block_counts or block_gradient over all tokens of a slice of the training texts.

    A task reads the more text, the larger its sums are, so what is shuffled stays in proportion to the text."""
    shape = ((2,) if counts else ()) + model.weights.shape
    tasks = max(4, -(-chars // (SLICES * TASK_CHARS << model.bits - LEAST_BITS)))
    own = train.where(F.pmod(F.xxhash64("text"), F.lit(SLICES)) == number).coalesce(tasks)
    shared = train.sparkSession.sparkContext.broadcast(model)
    add_block = block_counts if counts else block_gradient

    def run(batches):
        c.forget()
        model = shared.value
        total, some = np.zeros(shape, np.float32), False
        for _, _, _, tokens in blocks_of(batches):
            some = True
            add_block(model, tokens, total)
        if some:
            parts = total.reshape(-1, PART_ROWS * BASE)
            for first in range(0, len(parts), 64):
                own = parts[first : first + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(own)), pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], ["part", "sums"])

    def add(key, table):
        total = np.zeros(PART_ROWS * BASE, np.float64)
        for blob in table.column("sums").to_pylist():
            total += np.frombuffer(blob, np.float32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    got = added(own.mapInArrow(run, "part int, sums binary"), add, "part int, sums binary").toArrow()
    out = np.zeros(shape, np.float32)
    flat = out.reshape(-1, PART_ROWS * BASE)
    for part, blob in zip(got.column("part").to_pylist(), got.column("sums").to_pylist(), strict=True):
        flat[part] = np.frombuffer(blob, np.float32)
    shared.destroy()
    return out


def first_weights(model: Model, sums: np.ndarray) -> np.ndarray:
    """Sets the weights from the first slice, a lone feature's optimum damped as the features overlap; the curvature."""
    counts, expected = sums
    rows = np.maximum(counts.sum(-1, keepdims=True), 1e-9)
    prior = PRIOR * expected / rows
    model.weights = (FIRST_STEP * np.log((counts + prior + 1e-9) / (expected + prior + 1e-9))).astype(np.float32)
    return (np.maximum(counts, expected) * 0.5 + PRIOR).astype(np.float32)


def update(model: Model, sums: np.ndarray, curvature: np.ndarray) -> None:
    model.weights += np.clip(STEP * sums / curvature, -1, 1)


def row_bits(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, tokens.bit_length() - ROW_BITS))


def fit(train: DataFrame, known: Vocabulary, chars: int) -> Model:
    """Codes and biases from counts, then weights from the slices of the training texts, one update for each."""
    known.assign(group_words(train, known))
    model = Model(known, row_bits(known.tokens))
    if not known.tokens:
        return model
    curvature = first_weights(model, slice_sums(train, 0, model, chars, counts=True))
    for number in range(1, SLICES):
        update(model, slice_sums(train, number, model, chars, counts=False), curvature)
        c.release(train.sparkSession)
    return model


# ---- scores

ROW = (("uid", "<u8"), ("id", "<i8"), ("null", "u1"), ("held", "u1"), ("n", "<i8"), ("known", "<i8"), ("logs", "<f8"), ("model", "<f8"))
BLOCK = "part int, kind int, h binary, uid binary, n binary, rows binary"
ROW_TYPE = np.dtype(list(ROW))
SUM_TYPE = np.dtype([("uid", "<u8"), ("known", "<i8"), ("logs", "<f8")])
RARE, TEXT, COUNT, SUM = 0, 1, 2, 3


def block_batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), *(pa.array([p[2].get(f) for p in parts], pa.binary()) for f in ("h", "uid", "n", "rows"))], ["part", "kind", "h", "uid", "n", "rows"])


def scored_blocks(docs: DataFrame, model: Model, parts: int) -> DataFrame:
    """Rows of the texts with the sums of their frequent words, and their rare words by hash range."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        c.forget()
        model = shared.value
        known = model.known
        per_leaf = np.log10(known.leaf_tokens + 0.1 * known.leaf_words + 1e-300)
        seen: set[int] = set()
        place = (TaskContext.get().partitionId() + 1) * 0x9E3779B97F4A7C15 & c.MASK64
        rows, rare, total = [], [], 0

        def send():
            whole = np.concatenate(rows)
            out = [(p, TEXT, {"rows": whole[r].tobytes()}) for p, r in c.split_by((whole["uid"] % np.uint64(parts)).astype(np.int64), parts)]
            if rare:
                h, uid, n = (np.concatenate(x) for x in zip(*rare, strict=True))
                out += [(p, RARE, {"h": h[r].tobytes(), "uid": uid[r].tobytes(), "n": c.packed(n[r], "<i8")}) for p, r in c.split_by((h % np.uint64(parts)).astype(np.int64), parts)]
            return block_batch(out)

        for batch, first, n, tokens in blocks_of(batches, 2):
            at = known.find(tokens.hash)
            code = known.code_of(at)
            own = model.log_probabilities(tokens, code) / np.log(10) - per_leaf[code]  # -1 is the last, of others
            frequent = at >= 0
            row = np.zeros(n, ROW_TYPE)
            ids = batch.column(0).slice(first, n)
            row["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            row["null"] = ids.is_null().to_numpy(zero_copy_only=False)
            row["held"] = batch.column(1).slice(first, n).to_numpy(zero_copy_only=False)
            row["n"] = np.diff(tokens.first)
            row["known"] = np.bincount(tokens.text[frequent], minlength=n)
            row["logs"] = np.bincount(tokens.text[frequent], np.log10(known.counts[at[frequent]] + 0.1), n) if frequent.any() else 0.0
            row["model"] = np.bincount(tokens.text, own, n)
            # a text is named by its words, its id and the partition; a repeated row has the same name
            digest = np.add.reduceat(c.mix(tokens.hash + (np.arange(len(tokens.hash)) - tokens.first[tokens.text]).astype(np.uint64)), tokens.first[:-1])
            row["uid"] = c.mix(digest ^ c.mix(row["id"].astype(np.uint64) + np.uint64(place)) + row["null"].astype(np.uint64))
            rows.append(row)
            new = np.array([u not in seen and not seen.add(u) for u in row["uid"].tolist()], bool)
            keep = ~frequent & new[tokens.text]
            key = np.stack([tokens.text[keep].astype(np.uint64), tokens.hash[keep]])
            order = np.lexsort((key[1], key[0]))
            text, h = key[0][order], key[1][order]
            edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
            rare.append((h[edge], row["uid"][text[edge].astype(np.int64)], np.diff(np.append(edge, len(h)))))
            total += len(edge) + n
            if total >= HELD:
                yield send()
                rows, rare, total = [], [], 0
        if rows:
            yield send()

    return docs.select(F.col("doc_id").cast("long"), (c.crc_of_id() % 10 == 0).alias("held"), "text").mapInArrow(run, BLOCK)


def meet_counts(blocks: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """By hash range: sums over the rare words of each text, sent to the text's part; the texts' rows pass."""
    theirs = counts.select("part", F.lit(COUNT).alias("kind"), "h", F.lit(None).cast("binary").alias("uid"), "n", F.lit(None).cast("binary").alias("rows"))

    def run(table):
        kind = np.array(table.column("kind").to_pylist())
        columns = {f: table.column(f).to_pylist() for f in ("h", "uid", "n", "rows")}
        part = table.column("part").to_pylist()
        out = [(part[i], TEXT, {"rows": columns["rows"][i]}) for i in np.flatnonzero(kind == TEXT)]
        rare = np.flatnonzero(kind == RARE)
        if len(rare):
            h, uid, n = (c.joined([columns[f][i] for i in rare], k) for f, k in (("h", "<u8"), ("uid", "<u8"), ("n", "<i8")))
            have = np.flatnonzero(kind == COUNT)
            words, count = (c.joined([columns[f][i] for i in have], k) for f, k in (("h", "<u8"), ("n", "<i8")))
            found = np.zeros(len(h), np.int64)
            if len(words):
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                found = np.where(words[at] == h, count[at], 0)
            names, place = np.unique(uid, return_inverse=True)
            sums = np.zeros(len(names), SUM_TYPE)
            sums["uid"] = names
            sums["known"] = np.bincount(place, n * (found > 0), len(names))
            sums["logs"] = np.bincount(place, n * np.log10(found + 0.1), len(names))
            out += [(p, SUM, {"rows": sums[r].tobytes()}) for p, r in c.split_by((names % np.uint64(parts)).astype(np.int64), parts)]
        return pa.Table.from_batches([block_batch(out)]).select(["part", "kind", "rows"])

    return blocks.unionByName(theirs).groupBy("part").applyInArrow(run, "part int, kind int, rows binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finished(blocks: DataFrame, known: Vocabulary) -> DataFrame:
    tokens = known.tokens
    total = float(np.log10(known.tokens + 0.1 * (known.words + 1)))

    def run(table):
        kind = np.array(table.column("kind").to_pylist())
        blobs = table.column("rows").to_pylist()
        rows = np.frombuffer(b"".join(blobs[i] for i in np.flatnonzero(kind == TEXT)), ROW_TYPE)
        sums = np.frombuffer(b"".join(blobs[i] for i in np.flatnonzero(kind == SUM)), SUM_TYPE)
        n_known, logs = rows["known"].copy(), rows["logs"].copy()
        if len(rows) and len(sums):
            names, place = np.unique(sums["uid"], return_inverse=True)
            more, more_logs = np.bincount(place, sums["known"], len(names)), np.bincount(place, sums["logs"], len(names))
            at = np.searchsorted(names, rows["uid"])
            at[at == len(names)] = 0
            hit = names[at] == rows["uid"]
            n_known[hit] += more[at[hit]].astype(np.int64)
            logs[hit] += more_logs[at[hit]]
        columns = [pa.array(rows["id"], pa.int64(), mask=rows["null"].astype(bool)), pa.array(rows["held"].astype(bool)), pa.array(rows["n"]), pa.array(n_known), pa.array(np.full(len(rows), tokens, np.int64)), pa.array(logs - rows["n"] * total), pa.array(logs + rows["model"])]
        return pa.table(columns, names=[x.split()[0] for x in SCORES.split(", ")])

    return blocks.groupBy("part").applyInArrow(run, SCORES)


def score(docs: DataFrame) -> DataFrame:
    """Trains on the texts outside the held-out fold and scores all."""
    spark = docs.sparkSession
    c.small_batches(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(c.parallelism(spark), -(-chars // BUCKET_CHARS))
    train = training(docs)
    counts = c.written(count_words(train, parts), "lm-counts")
    model = fit(train, vocabulary(counts), chars)
    blocks = meet_counts(scored_blocks(docs, model, parts), counts, parts)
    return finished(blocks, model.known)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(c.documents(spark, sf_dir))
