"""A toxicity classifier with counterfactual regularisation.

Features are the distinct terms of a text (runs of letters and digits, A-Z folded) and their prefixes of four
to seven bytes, hashed into 2^22 cells.  A logistic regression with an L1 penalty is fitted by proximal gradient steps on a
bounded, documented sample of labelled rows.

Counterfactuals: in each labelled text that names a group (by the term itself, not by its cell), the identity term is
swapped for those of the other groups of its kind; into each labelled text, whether it names a group or not, terms of
``INSERTED`` groups are put, chosen by the text's hash.  The squared change of the score (its log odds) by a swap or an
insertion is penalised: a mention as such must not move a score, so neutral mentions aren't taken for attacks.

Scoring reads every text whole, in array batches, with the weights broadcast (bounded by ``FEATURES``).

Nulls in text count as empty texts, which score the bias alone; a label row with null doc_id or null toxic is
not learned from; rows repeated in documents are scored each; a doc_id with several labels is learned by each
of them; extra columns are ignored; with no labelled row, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Labelled rows learned from, at most: those with the smallest hash of doc_id (twice as many rows of documents, where it repeats them).
SAMPLE = 9_000
#: Features kept, at most; documents of the sample that must have a feature;
#: and the deviations by which the labels of those documents differ from the rest, at least.
FEATURES, MIN_DOCUMENTS, LIFT = 200_000, 3, 4.0
PREFIXES = (4, 5, 6, 7)
#: log2 of the cells that features are hashed into.
CELL_BITS = 22
#: L1 and counterfactual penalties, gradient steps, and the score from which a text counts as toxic.
L1, COUNTERFACTUAL, STEPS, THRESHOLD = 2e-4, 1.0, (200, 600), 0.7

#: Groups put into each labelled text.
INSERTED = 3

#: Identity terms by kind and language; in a line, terms of the groups that stand for each other.
IDENTITY = (
    # religion: English, French, German, Spanish
    ("christian", "muslim", "jew", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    # origin
    ("black", "white", "asian", "latino", "indigenous", "african", "european"),
    ("noir", "blanc", "asiatique", "latino", "autochtone", "africain", "européen"),
    ("noirs", "blancs", "asiatiques", "latinos", "autochtones", "africains", "européens"),
    ("schwarze", "weiße", "asiaten", "latinos", "indigene", "afrikaner", "europäer"),
    ("negro", "blanco", "asiático", "latino", "indígena", "africano", "europeo"),
    ("negros", "blancos", "asiáticos", "latinos", "indígenas", "africanos", "europeos"),
    # gender
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("girls", "boys"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("fille", "garçon"),
    ("filles", "garçons"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("niña", "niño"),
    ("niñas", "niños"),
    # orientation
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("gay", "lesbienne", "hétérosexuel", "bisexuel", "transgenre"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell", "transgender"),
    ("gay", "lesbiana", "heterosexual", "bisexual", "transgénero"),
    # migration
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("immigré", "réfugié", "autochtone", "étranger"),
    ("immigrés", "réfugiés", "autochtones", "étrangers"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer"),
    ("inmigrante", "refugiado", "nativo", "extranjero"),
    ("inmigrantes", "refugiados", "nativos", "extranjeros"),
    # age and disability
    ("old", "young"),
    ("vieux", "jeunes"),
    ("alte", "junge"),
    ("viejos", "jóvenes"),
    ("disabled", "blind", "deaf"),
    ("handicapé", "aveugle", "sourd"),
    ("behindert", "blind", "gehörlos"),
    ("discapacitado", "ciego", "sordo"),
)


def features(words: c.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct, sorted by text."""
    hashes, texts = [words.hash], [words.text]
    for k in PREFIXES:
        h = words.prefixes(k)
        keep = h != 0
        hashes.append(h[keep])
        texts.append(words.text[keep])
    cell = (np.concatenate(hashes) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    pairs = np.unique(np.concatenate(texts) << CELL_BITS | cell)
    return pairs >> CELL_BITS, pairs & (1 << CELL_BITS) - 1


def term_features(term: str) -> np.ndarray:
    raw = term.encode()
    return features(c.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), c.TERMS))[1]


class Identity:
    """The identity terms: their hashes in order, their features, and the terms that each may be swapped for."""

    def __init__(self, lines: tuple[tuple[str, ...], ...] = IDENTITY):
        self.terms = sorted({t for line in lines for t in line})
        place = {t: i for i, t in enumerate(self.terms)}
        others: list[set[int]] = [set() for _ in self.terms]
        for line in lines:
            for t in line:
                others[place[t]] |= {place[x] for x in line if x != t}
        self.others = [sorted(x) for x in others]
        self.features = [term_features(t) for t in self.terms]
        raw = [t.encode() for t in self.terms]
        words = c.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), c.TERMS)
        if len(words.hash) != len(self.terms):
            raise ValueError("an identity term is no single term")
        self.order = np.argsort(words.hash)
        self.hashes = words.hash[self.order]

    def found(self, words: c.Words) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and the identity term each is: by the whole hash of the term."""
        at = np.searchsorted(self.hashes, words.hash)
        at[at == len(self.hashes)] = 0
        where = np.flatnonzero(self.hashes[at] == words.hash)
        return where, self.order[at[where]]

    def changes(self, own: np.ndarray, words: c.Words, first: int, last: int, found: dict[int, list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features that go, features that come) of each counterfactual of the text of words first..last.

        own: the text's features; found: its word numbers of each identity term in it."""
        out = []
        for term, at in found.items():
            rest = word_features(words, np.setdiff1d(np.arange(first, last), at))
            for other in self.others[term]:
                new = np.union1d(rest, self.features[other])
                out.append((np.setdiff1d(own, new), np.setdiff1d(new, own)))
        key = int(np.bitwise_xor.reduce(words.hash[first:last])) if last > first else 0
        for i in range(INSERTED):
            term = int(c.mix(np.array([key + i * 0x9E3779B97F4A7C15 & c.MASK64], np.uint64))[0]) % len(self.terms)
            out.append((own[:0], np.setdiff1d(self.features[term], own)))
        return out


def word_features(words: c.Words, which: np.ndarray) -> np.ndarray:
    """The distinct features of some of the words."""
    hashes = [words.hash[which]]
    for k in PREFIXES:
        h = words.prefixes(k)[which]
        hashes.append(h[h != 0])
    return np.unique((np.concatenate(hashes) >> np.uint64(64 - CELL_BITS)).astype(np.int64))


def counterfactuals(identity: Identity, words: c.Words, n: int, text: np.ndarray, cell: np.ndarray) -> list[bytes]:
    """For each text its changes, as int32: for each the number of features that go, of those that come, and both."""
    edges = np.searchsorted(text, np.arange(n + 1))
    where, term = identity.found(words)
    at = np.searchsorted(where, words.first)
    out = []
    for i in range(n):
        found: dict[int, list[int]] = {}
        for w, t in zip(where[at[i] : at[i + 1]].tolist(), term[at[i] : at[i + 1]].tolist(), strict=True):
            found.setdefault(t, []).append(w)
        parts = []
        for gone, came in identity.changes(cell[edges[i] : edges[i + 1]], words, int(words.first[i]), int(words.first[i + 1]), found):
            parts += [[len(gone), len(came)], gone, came]
        out.append(np.concatenate(parts).astype("<i4").tobytes())
    return out


class Model:
    """Sorted features, their weights and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def scores(self, texts: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            z += np.bincount(texts[hit], self.weights[at[hit]], n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, changes: list[np.ndarray] = (), l1: float = L1, counterfactual: float = COUNTERFACTUAL, steps: tuple[int, int] = STEPS) -> Model:
    """rows: distinct features of each labelled text; changes: as counterfactuals() gives them.

    The first steps choose the features under the L1 penalty; the others fit those alone, under a quarter of it."""
    n = len(rows)
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    cells = 1 << CELL_BITS
    rate = labels.mean()
    count, positive = np.zeros(cells, np.int32), np.zeros(cells, np.int32)
    for row, label in zip(rows, labels, strict=True):  # a row's features are distinct
        count[row] += 1
        if label:
            positive[row] += 1
    # the features whose documents differ most from the rest
    some = np.flatnonzero(count >= MIN_DOCUMENTS)
    lift = np.abs(positive[some] - count[some] * rate) / np.sqrt(count[some] * max(rate * (1 - rate), 1e-9))
    some, lift = some[lift > LIFT], lift[lift > LIFT]
    vocabulary = np.sort(some[np.argpartition(-lift, FEATURES)[:FEATURES]]) if len(some) > FEATURES else some
    size = len(vocabulary)
    new = np.full(cells, -1, np.int32)
    new[vocabulary] = np.arange(size)
    columns = [new[row] for row in rows]
    columns = [x[x >= 0] for x in columns]
    text = np.repeat(np.arange(n), [len(x) for x in columns])
    column = np.concatenate(columns).astype(np.int64)
    swap_row, swap_column, swap_sign, n_swaps = known_changes(changes, new)
    # both classes weigh the same number of rows at most 4:1, so that a rare class is learned too
    weight = np.where(labels == 1, min(4.0, (1 - rate) / max(rate, 1e-9)), 1.0)
    weight /= weight.sum()
    w, bias = descend(text, column, labels, weight, (swap_row, swap_column, swap_sign, n_swaps), size, l1, counterfactual, steps[0], np.zeros(size), 0.0)
    kept = np.flatnonzero(w)
    new = np.full(size, -1)
    new[kept] = np.arange(len(kept))
    inside, swapped = new[column] >= 0, new[swap_column] >= 0
    swap = swap_row[swapped], new[swap_column[swapped]], swap_sign[swapped], n_swaps
    w, bias = descend(text[inside], new[column[inside]], labels, weight, swap, len(kept), l1 / 4, counterfactual, steps[1], w[kept], bias)
    return Model(vocabulary[kept], w, bias)


def known_changes(changes: list[np.ndarray], new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Change, feature and sign of each feature that a change adds or takes and the model has; and how many changes there are."""
    rows, columns, signs, n = [], [], [], 0
    for blob in changes:
        at = 0
        while at < len(blob):
            gone, came = int(blob[at]), int(blob[at + 1])
            column = new[blob[at + 2 : at + 2 + gone + came]]
            sign = np.repeat([-1.0, 1.0], [gone, came])
            keep = column >= 0
            rows.append(np.full(int(keep.sum()), n))
            columns.append(column[keep])
            signs.append(sign[keep])
            at += 2 + gone + came
            n += 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    return np.concatenate(rows).astype(np.int64), np.concatenate(columns).astype(np.int64), np.concatenate(signs), n


def steepest(row, column, sign, n: int, size: int, rounds: int = 30) -> float:
    """The largest eigenvalue of the mean outer product of the changes, by power iteration."""
    if not n or not len(row):
        return 0.0
    v, value = np.bincount(column, minlength=size) + 0.01, 0.0
    for _ in range(rounds):
        v = v / np.linalg.norm(v)
        v = np.bincount(column, sign * np.bincount(row, sign * v[column], n)[row], size) / n
        value = float(np.linalg.norm(v))
        if not value:
            return 0.0
    return value


def descend(text, column, labels, weight, swap, size, l1, counterfactual, steps, w, bias) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps from (w, bias); the step is halved, and the pace dropped, where the loss runs off."""
    swap_row, swap_column, swap_sign, n_swaps = swap
    n = len(labels)
    v, v_bias, momentum, best = w.copy(), bias, 1.0, np.inf
    widths = np.bincount(text, minlength=n) + 1
    penalty = counterfactual if len(swap_row) else 0.0
    step = 1 / (0.25 * float((weight * widths).sum()) / 8 + 2.2 * penalty * steepest(swap_row, swap_column, swap_sign, n_swaps, size))
    for _ in range(steps):
        z = np.bincount(text, v[column], n) + v_bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -float((weight * np.where(labels == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum())
        change = np.bincount(swap_row, swap_sign * v[swap_column], n_swaps) if penalty else np.zeros(1)
        loss += penalty * float((change**2).mean())
        if loss > 2 * best + 0.5:
            step, v, v_bias, momentum = step / 2, w.copy(), bias, 1.0
            continue
        best = min(loss, best)
        error = weight * (p - labels)
        gradient = np.bincount(column, error[text], size).astype(float)  # whole numbers where there are no features
        if penalty:
            gradient += 2 * penalty / n_swaps * np.bincount(swap_column, swap_sign * change[swap_row], size)
        new_w = v - step * gradient
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
        new_bias = v_bias - step * float(error.sum())
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        v = new_w + (momentum - 1) / after * (new_w - w)
        v_bias = new_bias + (momentum - 1) / after * (new_bias - bias)
        w, bias, momentum = new_w, new_bias, after
    return w, bias


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how) -> Model:
    """Fits on the labelled rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    c.small_batches(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (c.crc_of_id() % 3 != 1)).select(F.col("doc_id").alias("__df_id"), F.col("toxic").cast("int").alias("__df_toxic"))
    chosen = chosen.orderBy(F.xxhash64("__df_id"), "__df_id", "__df_toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__df_id")).select("doc_id", "__df_toxic", "text")

    def run(batches):
        c.forget()
        identity = Identity()
        for batch in batches:
            out, changes = [], []
            for _, n, raw, bounds in c.text_blocks(batch.column(2)):
                words = c.Words(raw, bounds, c.TERMS)
                text, h = features(words)
                edges = np.searchsorted(text, np.arange(n + 1))
                out += [h[edges[i] : edges[i + 1]].astype("<i4").tobytes() for i in range(n)]
                changes += counterfactuals(identity, words, n, text, h)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(out, pa.binary()), pa.array(changes, pa.binary())], ["doc_id", "toxic", "features", "changes"])

    # `sample` label rows; where documents repeats the rows of labelled ones, those of the smallest ids up to twice as many
    got = rows.mapInArrow(run, "doc_id long, toxic int, features binary, changes binary").orderBy("doc_id", "toxic", "features").limit(2 * sample).toArrow()
    features_, changes_, labels_ = got.column("features").to_pylist(), got.column("changes").to_pylist(), np.array(got.column("toxic").to_pylist(), float)
    del got
    model = fit([np.frombuffer(x, "<i4") for x in features_], labels_, [np.frombuffer(x, "<i4") for x in changes_], **how)
    del features_, changes_
    c.release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __df_score."""
    spark = docs.sparkSession
    c.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        out = np.empty(len(texts))
        for first, n, raw, bounds in c.text_blocks(pa.array(texts, pa.string(), from_pandas=True)):
            text, h = features(c.Words(raw, bounds, c.TERMS))
            out[first : first + n] = shared.value.scores(text, h, n)
        return pd.Series(out)

    return docs.withColumn("__df_score", scored("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """docs with __df_score and __df_toxic (1 from the threshold on)."""
    scored = score(docs, learn(docs, labels, **how))
    return scored.withColumn("__df_toxic", (F.col("__df_score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = classify(docs, labels)
    return out.select("doc_id", (c.crc_of_id() % 3 == 1).alias("held_out"), F.col("__df_score").alias("score"), F.col("__df_toxic").alias("predicted"))
