"""Substring dedup: every word covered by a 20-word window that also starts earlier is removed.

1. Count-min prefilter.  A window is represented by its anchor, the smallest hash among its 10-word runs
   (the leftmost of equals): equal windows have equal anchors at equal places, so an anchor that occurs once
   can't belong to a repeated window.  Anchors are a sixth of the windows.  Partitions sketch the anchors they
   hold, the sketches are merged, and the merged counts overestimate.
2. The second pass sends only windows whose anchor is estimated repeated, with 128 bits of their words, to
   exact grouping.  A partition sends one row per distinct window (its first occurrence); the later ones it
   knows to be removed.  So a window that a third of all documents share reaches its group once a partition.
3. Word spans of the removed windows come together by document and meet the text again by a join.

Blocks of arrays, not rows, go through the shuffles.

Words are separated by 0x20 and 0x09-0x0D.  A null text has no words.  Order is by doc_id, then place; a null
doc_id comes last.  Rows with one doc_id are judged separately: windows at the same place of such rows don't
remove each other, others do.  Extra columns are kept, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import sketch

WINDOW, ANCHOR = 20, 10
#: Characters of text to a bucket of the exact grouping; windows a partition holds before it sends them.
BUCKET_CHARS, HELD = 12_000_000, 3_000_000
BLOCKS = "part int, kind int, h1 binary, h2 binary, doc binary, tag binary, pos binary"
FIELDS = (("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<i4"))


def anchors(words: c.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, anchor's hash and anchor's place of every window."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = c.roll(words.hash, anchor)
    place = np.arange(len(low))
    span, wanted = 1, window - anchor + 1
    while span < wanted:
        step = min(span, wanted - span)
        right, right_place = low[step:], place[step:]
        low, place = low[: len(right)], place[: len(right)]
        later = right < low
        low, place = np.where(later, right, low), np.where(later, right_place, place)
        span += step
    at = np.flatnonzero(words.text[:n] == words.text[window - 1 :])
    return at, low[at], place[at]


def sketch_parts(docs: DataFrame, bits: int, window: int, anchor: int) -> DataFrame:
    def run(batches):
        c.forget()
        held, n = [], 0
        for batch in batches:
            for _, _, raw, bounds in c.text_blocks(batch.column(0)):
                at, low, place = anchors(c.Words(raw, bounds), window, anchor)
                if len(at):
                    new = np.ones(len(place), bool)
                    new[1:] = place[1:] != place[:-1]
                    held.append(low[new])
                    n += len(held[-1])
            if n >= HELD:
                yield sketch.partition_rows(np.concatenate(held), bits)
                held, n = [], 0
        if held:
            yield sketch.partition_rows(np.concatenate(held), bits)

    return docs.select("text").mapInArrow(run, sketch.PARTS)


def block_batch(parts: list[tuple[int, int, dict]]) -> pa.RecordBatch:
    columns = [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32())]
    columns += [pa.array([c.packed(p[2][f], kind) if f in p[2] else None for p in parts], pa.binary()) for f, kind in FIELDS]
    return pa.RecordBatch.from_arrays(columns, ["part", "kind", *(f for f, _ in FIELDS)])


def doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return (c.mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def by_document(parts: int, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray):
    for part, rows in c.split_by(doc_part(doc, parts), parts):
        yield part, 1, {"doc": doc[rows], "tag": tag[rows], "pos": pos[rows]}


def leaders(h1, h2, doc, tag, pos) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, document and place, and for each row in it the place of its window's first row."""
    order = np.lexsort((pos, doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return order, first[np.cumsum(new) - 1]


def window_blocks(docs: DataFrame, repeated, parts: int, window: int, anchor: int) -> DataFrame:
    """Kind 0: first occurrences in a partition, by window; kind 1: places known to be removed, by document."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def send(held):
        h1, h2, doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order, lead = leaders(h1, h2, doc, tag, pos)
        doc_o, tag_o, pos_o = doc[order], tag[order], pos[order]
        first = (doc_o == doc_o[lead]) & (pos_o == pos_o[lead])
        keep = order[first]
        out = list(by_document(parts, doc_o[~first], tag_o[~first], pos_o[~first])) if not first.all() else []
        for part, rows in c.split_by((h1[keep] % np.uint64(parts)).astype(np.int64), parts):
            rows = keep[rows]
            out.append((part, 0, {"h1": h1[rows], "h2": h2[rows], "doc": doc[rows], "tag": tag[rows], "pos": pos[rows]}))
        return block_batch(out)

    def run(batches):
        c.forget()
        held, n = [], 0
        for batch in batches:
            ids = c.ids_of(batch.column(0))
            for first, rows, raw, bounds in c.text_blocks(batch.column(1)):
                words = c.Words(raw, bounds)
                at, low, _ = anchors(words, window, anchor)
                at = at[shared.value(low)] if len(at) else at
                if not len(at):
                    continue
                tags = np.array([zlib.crc32(raw[bounds[i] : bounds[i + 1]]) for i in range(rows)], np.uint32)
                text = words.text[at]
                h2 = c.roll(c.mix(words.hash ^ np.uint64(0xC2B2AE3D27D4EB4F)), window)
                held.append((c.roll(words.hash, window)[at], h2[at], ids[first + text], tags[text], (at - words.first[text]).astype(np.int32)))
                n += len(at)
            if n >= HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def removed_places(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks by document of the places that hold a window which starts earlier too."""

    def judge(table):
        kind = np.array(table.column("kind").to_pylist())
        whole = {f: table.column(f).to_pylist() for f, _ in FIELDS}
        out = [(int(table.column("part")[i].as_py()), 1, {f: np.frombuffer(whole[f][i], k) for f, k in FIELDS[2:]}) for i in np.flatnonzero(kind == 1)]
        rows = np.flatnonzero(kind == 0)
        if len(rows):
            h1, h2, doc, tag, pos = (c.joined([whole[f][i] for i in rows], k) for f, k in FIELDS)
            order, lead = leaders(h1, h2, doc, tag, pos)
            doc, tag, pos = doc[order], tag[order], pos[order]
            later = (doc != doc[lead]) | (pos != pos[lead])
            out += by_document(parts, doc[later], tag[later], pos[later])
        return pa.Table.from_batches([block_batch(out)]).select(["part", "doc", "tag", "pos"])

    return blocks.groupBy("part").applyInArrow(judge, "part int, doc binary, tag binary, pos binary")


def spans(blocks: DataFrame, window: int) -> DataFrame:
    """Spans of removed words of each document: pairs of first and last word + 1."""

    def merge(table):
        doc, tag, pos = (c.joined(table.column(f).to_pylist(), k) for f, k in FIELDS[2:])
        order = np.lexsort((pos, tag, doc))
        doc, tag, pos = doc[order], tag[order], pos[order].astype(np.int64)
        new_doc = np.ones(len(doc), bool)
        new_doc[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        new = new_doc.copy()
        new[1:] |= pos[1:] > pos[:-1] + window
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1
        pairs = np.stack([pos[first], pos[last] + window], axis=1).astype("<i4")
        at = np.flatnonzero(new_doc[first])
        ends = np.append(at[1:], len(first))
        return pa.table({"__df_id": pa.array(doc[first[at]], pa.int64()), "__df_tag": pa.array(tag[first[at]].astype(np.int64), pa.int64()), "__df_spans": pa.array([pairs[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})

    return blocks.groupBy("part").applyInArrow(merge, "__df_id long, __df_tag long, __df_spans binary")


def removals(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, int]:
    """__df_id, __df_tag (crc32 of the text), __df_spans of the documents that lose words; and partitions for the texts."""
    spark = docs.sparkSession
    c.small_batches(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = sketch.width_bits(chars // 30)  # a word is about six characters, an anchor stands for some five words
    parts = max(c.parallelism(spark), -(-chars // BUCKET_CHARS))
    repeated = sketch.collect(sketch_parts(docs, bits, window, anchor), bits)
    c.release(spark)
    blocks = window_blocks(docs, repeated, parts, window, anchor)
    return spans(removed_places(blocks, parts), window), parts


def with_spans(docs: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """docs with __df_spans; the partitions of the join follow the size of the texts."""
    keyed = docs.withColumns({"__df_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(c.NULL_ID)), "__df_crc": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    keyed, found = keyed.repartition(parts, "__df_key", "__df_crc"), found.repartition(parts, "__df_id", "__df_tag")
    return keyed.join(found, (F.col("__df_key") == F.col("__df_id")) & (F.col("__df_crc") == F.col("__df_tag")), "left")


def kept_words(text: str | None, blob: bytes | None) -> tuple[int, int, list[bytes]]:
    """Number of words, number removed, the words that stay."""
    words = (text or "").encode().split()  # splits at 0x20 and 0x09-0x0D
    n = len(words)
    for first, last in np.frombuffer(blob, "<i4").reshape(-1, 2)[::-1] if blob else ():
        del words[first:last]
    return n, n - len(words), words


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""
    joined = with_spans(docs.select("doc_id", "text"), *removals(docs, window)).select("doc_id", "text", "__df_spans")

    def run(batches):
        c.forget()
        for batch in batches:
            n, gone, sha = [], [], []
            for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total, removed, words = kept_words(text, blob)
                n.append(total)
                gone.append(removed)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with removed words cut out of text; a text that loses none stays as it is.

    A text that loses some is its kept words joined by one space."""
    c.small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(text, blob):
        import pandas as pd

        return pd.Series([b" ".join(kept_words(t, b)[2]).decode() for t, b in zip(text, blob, strict=True)])

    joined = with_spans(docs, *removals(docs, window))
    text = F.when(F.col("__df_spans").isNull(), F.col("text")).otherwise(cut("text", "__df_spans"))
    return joined.withColumn("text", text).select(*(F.col(f"`{name}`") for name in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(c.documents(spark, sf_dir))
