"""Quality rules by tokeniser fertility, with rejection bands per language (or script) and size of text.

A public vocabulary with byte fallback is run over every word.  Three measures of a text say how natural it is
to the vocabulary: characters per token, the share of byte-fallback tokens, and the entropy of its tokens.
Bands come from all texts that pass the base rules, copies of a text once: for each language (for each script, where no
language is given) and each size class (power of two of tokens), the median plus or minus a multiple of the range of
the middle 80 %.  Deciles are exact over a fixed grid of values, so they don't depend on how the texts are dealt.
A text outside its band is rejected; so is one that breaks the base rules.

Words are separated by 0x20 and 0x09-0x0D.  A null text has no words and fails the base rules.  Null languages
are banded by script.  Where a class has fewer than ``SUPPORT`` distinct texts, the next wider one stands for it:
the language of all sizes, the script by size, the script of all sizes, and all texts.  Repeated rows are judged alike and
counted once in the bands; extra columns are kept by ``apply``; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

REPEAT = 8
#: A text fails with fewer words, or with more than this share of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 20, 30
SYMBOLS = "[#*$%&|<>]"
#: Distinct texts of a class, ranges (tenth to ninth decile) from the median, and the least half width of a band.
SUPPORT, RANGES = 30, 1.6
LEAST = {"chars_per_token": 0.08, "fallback_share": 0.10, "entropy": 0.05}
#: Steps of the grids on which the deciles are taken, to the unit.
GRID = {"chars_per_token": 256, "fallback_share": 4096, "entropy": 4096}
#: A text can't be too rich in tokens: these have no upper bound.
ONE_SIDED = {"entropy"}
CACHE = 200_000
#: Bands that are broadcast, at most; more are joined by a shuffle.
BROADCAST_BANDS = 50_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy double, script string, text_hash long"

symbol = np.zeros(256, np.int64)
symbol[list(b"#*$%&|<>")] = 1

#: Script by a letter's first byte in UTF-8 (rough, for bands only).
SCRIPT = np.zeros(256, np.int64)
SCRIPT[65:91] = SCRIPT[97:123] = SCRIPT[0xC3:0xCA] = 1
SCRIPT[0xCE:0xD0], SCRIPT[0xD0:0xD5], SCRIPT[0xD6:0xD8], SCRIPT[0xD8:0xDC], SCRIPT[0xE0:0xE2], SCRIPT[0xE3:0xEE] = 2, 3, 4, 5, 6, 7
SCRIPTS = ("other", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "east asian")

class Fertility:
    """Token ids of words, remembered for short words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.unknown = 0  # words that found no room
        n = self.model.get_piece_size()
        self.fallback = np.array([self.model.is_byte(i) for i in range(n)])

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        known = self.known
        found = [list(map(known.get, row)) for row in texts]
        missing = list({w for row, got in zip(texts, found, strict=True) for w, ids in zip(row, got, strict=True) if ids is None})
        new: dict[str, bytes] = {}
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            new.update((w, np.array(ids, "<i4").tobytes()) for w, ids in zip(part, self.model.encode(part, num_threads=1), strict=True))
        if len(known) + len(new) <= CACHE:
            known.update((w, ids) for w, ids in new.items() if len(w) <= 64)
        else:
            self.unknown += len(new)
            if self.unknown > 50 * CACHE:  # the texts have moved on: remember anew
                known.clear()
                self.unknown = 0
        return [np.frombuffer(b"".join([new[w] if ids is None else ids for w, ids in zip(row, got, strict=True)]), "<i4") for row, got in zip(texts, found, strict=True)]


def worker(path: str) -> Fertility:
    return c.remembered(("quality", path), lambda: Fertility(path))


def repeated_words(words: c.Words, n: int, k: int = REPEAT) -> np.ndarray:
    """Words of each text in windows of k words found twice or more in it."""
    rolled, at = words.windows(k)
    if not len(at):
        return np.zeros(n, np.int64)
    text = words.text[at]
    order = np.lexsort((rolled, text))
    a, t = rolled[order], text[order]
    same = (a[1:] == a[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(a), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    delta = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + k, -1)
    covered = np.cumsum(delta[:-1]) > 0
    return np.bincount(words.text[covered], minlength=n)


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(column: pa.Array, fertility: Fertility) -> pa.StructArray:
    """The measures of a column of texts."""
    column = column.cast(pa.string())
    texts = column.fill_null("").to_pylist()
    parts = []
    for first, n, raw, bounds in c.text_blocks(column):
        words = c.Words(raw, bounds)
        begin = (raw & 0xC0) != 0x80
        chars = per_text(begin & (c.WORDS[raw] != 0), bounds)
        letters = np.stack([per_text(SCRIPT[raw] == s, bounds) for s in range(1, len(SCRIPTS))])
        script = np.where(letters.max(0) > 0, letters.argmax(0) + 1, 0)
        block = texts[first : first + n]
        ids = fertility.ids([WORD.findall(t) for t in block])
        tokens = np.array([len(x) for x in ids], np.int64)
        fallback = np.array([fertility.fallback[x].sum() for x in ids], np.int64)
        entropy = np.array([entropy_of(x) for x in ids])
        some = np.maximum(tokens, 1)
        parts.append((np.diff(words.first), chars, per_text(symbol[raw], bounds), np.array([duplicate_lines(t) for t in block], np.int64), repeated_words(words, n), tokens, chars / some, fallback / some, entropy, np.array(SCRIPTS)[script], np.array([text_key(words, i) for i in range(n)], np.int64)))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string(), pa.int64()]
    joined = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], kind) for i, kind in enumerate(kinds)]
    return pa.StructArray.from_arrays(joined, names)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_key(words: c.Words, i: int) -> int:
    h = words.hash[words.first[i] : words.first[i + 1]]
    return int(np.uint64(np.bitwise_xor.reduce(c.mix(h + np.arange(len(h), dtype=np.uint64)))).view(np.int64)) if len(h) else 0


def entropy_of(ids: np.ndarray) -> float:
    """Entropy of the ids as a share of the greatest that so many can have; 1 for one id or none."""
    n = len(ids)
    if n < 2:
        return 1.0
    count = np.bincount(ids)
    count = count[count > 0]
    return float((np.log2(n) - (count * np.log2(count)).sum() / n) / np.log2(n))


def measured(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column __df_m, the struct of MEASURES."""
    c.small_batches(docs.sparkSession)
    schema = "struct<" + ",".join(x.replace(" ", ":", 1) for x in MEASURES.split(", ")) + ">"

    @F.arrow_udf(schema)
    def measures(text: pa.Array) -> pa.Array:
        return measure(text, worker(path))

    return docs.withColumn("__df_m", measures("text"))


#: Classes of a text, from its own to that of all.
CLASSES = ("language, size", "language", "script, size", "script", "all")


def with_classes(rows: DataFrame) -> DataFrame:
    """Adds __df_classes to rows with lang and __df_m: the names of a text's classes, null where it has no language."""
    lang = F.when(F.trim(F.coalesce(F.col("lang"), F.lit(""))) != "", F.concat(F.lit("lang:"), F.translate("lang", "\n", " ")))
    script = F.concat(F.lit("script:"), F.col("__df_m.script"))
    size = F.concat(F.lit("\n"), F.floor(F.log2(F.greatest(F.col("__df_m.n_tokens"), F.lit(1)))).cast("string"))
    return rows.withColumn("__df_classes", F.array(F.concat(lang, size), lang, F.concat(script, size), script, F.lit("all")))


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def bands(rows: DataFrame) -> DataFrame:
    """__df_class, n and low and high bounds of each measure for each class with enough texts (that of all: with any).

    Texts are counted by class, measure and step of the grid before anything is shuffled; what comes together by class
    are the steps, a bounded number."""
    names = list(LEAST)
    values = rows.where(~base_failed(F.col("__df_m.n_words"), F.col("__df_m.n_repeat_words")))
    steps = [F.floor(F.col(f"__df_m.{x}") * GRID[x]).alias(x) for x in names]
    values = values.select("__df_classes", *steps, F.col("__df_m.text_hash").alias("h")).distinct()
    values = values.select(F.explode(F.array_compact("__df_classes")).alias("__df_class"), *names)
    values = values.select("__df_class", F.posexplode(F.array(*names)).alias("measure", "step"))
    counts = values.groupBy("__df_class", "measure", "step").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("__df_class", "measure").orderBy("step")
    whole = Window.partitionBy("__df_class", "measure")
    counts = counts.withColumns({"below": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    found = []
    for j, x in enumerate(names):
        own = F.col("measure") == j
        found += [F.min(F.when(own & (F.col("below") >= q * F.col("total")), F.col("step"))).alias(f"{x}_{int(q * 10)}") for q in (0.1, 0.5, 0.9)]
    deciles = counts.groupBy("__df_class").agg(F.max("total").alias("n"), *found)
    out = [F.col("__df_class"), F.col("n")]
    for x in names:
        low, middle, high = ((F.col(f"{x}_{q}") + 0.5) / GRID[x] for q in (1, 5, 9))
        half = F.greatest(F.lit(LEAST[x]), RANGES * (high - low))
        out += [(middle - half).alias(f"low_{x}"), (F.lit(float("inf")) if x in ONE_SIDED else middle + half).alias(f"high_{x}")]
    return deciles.where((F.col("n") >= SUPPORT) | (F.col("__df_class") == "all")).select(*out)


def judged(docs: DataFrame, path: str, with_text: bool = True) -> DataFrame:
    """docs with __df_m, __df_base_failed and __df_kept.

    The measures are written once to the shared folder: the bands need all of them before a text is judged.
    without with_text, the texts aren't written with them and don't come back."""
    rows = with_classes(measured(docs, path))
    rows = c.written(rows if with_text else rows.drop("text"), "quality-measures")
    found = c.written(bands(rows), "quality-bands")
    small = F.broadcast if found.count() <= BROADCAST_BANDS else (lambda df: df)
    bounds = [f"{side}_{x}" for x in LEAST for side in ("low", "high")]
    joined = rows
    for i, kind in enumerate(CLASSES):
        own = F.col("__df_class") == "all" if kind == "all" else F.col("__df_class").contains("\n") == kind.endswith("size")
        part = found.where(own & F.col("__df_class").startswith(("lang:", "lang:", "script:", "script:", "all")[i]))
        part = part.select(F.col("__df_class").alias(f"__b_{i}"), F.struct(*bounds).alias(f"__df_own{i}"))
        joined = joined.join(small(part), F.col("__df_classes")[i] == F.col(f"__b_{i}"), "left")
    band = F.coalesce(*(F.col(f"__df_own{i}") for i in range(len(CLASSES))))
    inside = F.lit(True)
    for x in LEAST:
        inside &= F.col(f"__df_m.{x}").between(band[f"low_{x}"], band[f"high_{x}"])
    failed = base_failed(F.col("__df_m.n_words"), F.col("__df_m.n_repeat_words"))
    return joined.withColumns({"__df_base_failed": failed, "__df_kept": ~failed & F.coalesce(inside, F.lit(True))})


def apply(docs: DataFrame, path: str) -> DataFrame:
    """The rows of docs that are kept."""
    return judged(docs, path).where("__df_kept").select(*(F.col(f"`{x}`") for x in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = judged(c.documents(spark, sf_dir).select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"), with_text=False)
    counts = [F.col(f"__df_m.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, F.col("__df_base_failed").alias("base_failed"), F.col("__df_kept").alias("kept"), F.col("__df_m.chars_per_token").alias("chars_per_token"), F.col("__df_m.fallback_share").alias("fallback_share"), F.col("__df_m.entropy").alias("entropy"))
