"""Byte-level BPE as a streaming transducer, and its inverse.

Encoding reads a text in blocks of any size and holds a bounded state:

* The pre-tokeniser cuts the text into pieces.  A piece is final once two later pieces are known, so the
  last two pieces of a block wait for the next block; one that outgrows a block stays open and is fed on.
* Every piece goes through the automaton of :mod:`transducer`: new ones of a batch of texts side by side in arrays,
  those longer than ``LANE`` bytes as a stream, which emits a token once the merge list's sufficient lookahead
  has passed.  What a short run of pieces gives is remembered in a bounded cache.

Nulls count as empty texts (no token), repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as c
from .transducer import Automaton, Stream

#: White space as the pre-tokeniser's pattern has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the byte-level vocabulary's published pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+" % ((SPACE,) * 4)
#: The same cuts, but for those within a run of other characters than white space.
PIECE = regex.compile(PATTERN)
COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Characters fed at once; bytes of a piece that is read beside others, at most.
BLOCK, LANE = 1 << 16, 1024
#: Entries of a worker's cache.
CACHE = 300_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level tokeniser file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        raw = {i: bytes(letters[ch] for ch in token) for token, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        raw |= {i: s.encode() for s, i in self.special.items()}
        #: bytes by id
        self.bytes = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.single = [0] * 256
        for i, b in raw.items():
            if len(b) == 1:
                self.single[b[0]] = i
        merges = (pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"])
        self.automaton = Automaton(self.bytes, self.single, [(ids[left], ids[right], ids[left + right]) for left, right in merges])
        self.unknown = 0  # chunks that found no room in the cache

    def sufficient_lookahead(self) -> int:
        """Bytes after a token's end that decide whether it stands, at most; from the merge list."""
        return self.automaton.lookahead

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes of int32."""
        long = [i for i, p in enumerate(pieces) if len(p) > LANE]
        if not long:
            return self.automaton.encode(pieces)
        out = self.automaton.encode([b"" if len(p) > LANE else p for p in pieces])
        for i in long:
            stream = Stream(self.automaton)
            out[i] = np.array(stream.feed(pieces[i]) + stream.finish(), "<i4").tobytes()
        return out


class Encoder:
    """Text in, ids out, block by block: ``feed`` as often as wanted, then ``finish``.

    ``runs`` and ``last`` are the same with each run of ids as a pair (ids, the ids in decimals)."""

    def __init__(self, vocabulary: Vocabulary, cache: dict | None = None, fresh: dict | None = None):
        """cache, fresh: known runs of chunks."""
        self.v = vocabulary
        self.cache = {} if cache is None else cache
        self.fresh = {} if fresh is None else fresh
        self.pattern = PIECE
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.held = ""
        self.open: tuple | None = None  # (continuation pattern, stream, whether it is white space) of a piece that outgrew a block

    def _run(self, ids: list[int]) -> tuple[tuple[int, ...], str]:
        return tuple(ids), ",".join(map(str, ids))

    def _chunks(self, chunks: list[str]) -> list[tuple]:
        """Ids of runs of characters that the coarse cuts separate from each other."""
        of, also = self.cache.get, self.fresh.get
        found = [of(x) or also(x) for x in chunks]
        if None in found:
            self.fresh = fresh_runs(self.v, self.cache, [chunks])
            also = self.fresh.get
            found = [run or of(x) or also(x) for x, run in zip(chunks, found, strict=True)]
        return found

    def _plain(self, text: str) -> list[tuple]:
        """Runs of a text without special strings, as a whole."""
        return self._chunks(COARSE.findall(text))

    def _whole(self, text: str) -> list[tuple]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        runs, at = [], 0
        for m in self.special.finditer(text):
            runs += self._plain(text[at : m.start()])
            runs.append(self._run([self.v.special[m[0]]]))
            at = m.end()
        return runs + self._plain(text[at:])

    def _partial(self, text: str) -> int:
        """Characters at the end that may begin a special string."""
        return next((n for n in range(min(len(text), max(map(len, self.v.special), default=1) - 1), 0, -1) if any(s.startswith(text[-n:]) for s in self.v.special)), 0)

    def _go_on(self, text: str, end_of_text: bool) -> tuple[list[tuple], str | None]:
        """Feeds an open piece; what is left of the text once the piece has ended, None while it goes on.

        The last character of an open run of white space is held: it isn't part of the piece if something else follows."""
        more, stream, blank = self.open
        keep = 0 if end_of_text else self._partial(text)
        end = more.match(text).end()
        special = self.special.search(text) if self.special else None
        if special:
            end = min(end, special.start())
        if end >= len(text) - keep and not end_of_text:
            end = max(0, len(text) - keep)
            if blank:
                end = max(0, end - 1)
            self.held = text[end:]
            return [self._run(stream.feed(text[:end].encode()))], None
        if blank and end < len(text) and not (special and special.start() == end):
            end -= 1
        self.open = None
        return [self._run(stream.feed(text[:end].encode()) + stream.finish())], text[end:]

    def runs(self, text: str) -> list[tuple]:
        runs: list[tuple] = []
        text, self.held = self.held + text, ""
        if self.open:
            runs, rest = self._go_on(text, False)
            if rest is None:
                return runs
            text = rest
        keep = self._partial(text)
        body, rest = text[: len(text) - keep], text[len(text) - keep :]
        at = 0
        if self.special:
            for m in self.special.finditer(body):
                runs += self._plain(body[at : m.start()]) + [self._run([self.v.special[m[0]]])]
                at = m.end()
        chunks = COARSE.findall(body[at:])
        runs += self._chunks(chunks[:-2])
        body = "".join(chunks[-2:])
        if len(body) > BLOCK:  # one very long run: its pieces but the last two are final
            pieces = self.pattern.findall(body)
            runs += self._pieces(pieces[:-2])
            body = "".join(pieces[-2:])
            m = regex.fullmatch(r"(?: ?(?:(\p{L}+)|(\p{N}+)|[^%s\p{L}\p{N}]+))|([%s]+)" % (SPACE, SPACE), pieces[-1])
            if len(body) > BLOCK and not rest and m:
                runs += self._pieces(pieces[-2:-1])
                more = r"\p{L}*" if m[1] else r"\p{N}*" if m[2] else f"[{SPACE}]*" if m[3] else r"[^%s\p{L}\p{N}]*" % SPACE
                self.open = regex.compile(more), Stream(self.v.automaton), bool(m[3])
                fed = pieces[-1][:-1] if m[3] else pieces[-1]
                runs.append(self._run(self.open[1].feed(fed.encode())))
                body = pieces[-1][len(fed) :]
        self.held = body + rest
        return runs

    def _pieces(self, pieces: list[str]) -> list[tuple]:
        return [self._run(np.frombuffer(ids, "<i4").tolist()) for ids in self.v.encode([p.encode() for p in pieces])]

    def last(self) -> list[tuple]:
        runs: list[tuple] = []
        held, self.held = self.held, ""
        if self.open:
            runs, held = self._go_on(held, True)
        return runs + self._whole(held)

    def feed(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.runs(text)))

    def finish(self) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.last()))


class Decoder:
    """Ids in, text out: a byte-to-text state machine that holds an unfinished character only."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def worker(path: str) -> tuple[Vocabulary, dict]:
    """This process's vocabulary and cache for a path."""
    return c.remembered(("bpe", path), lambda: (Vocabulary(path), {}))


def fresh_runs(v: Vocabulary, cache: dict, chunks: list[list[str]]) -> dict:
    """Runs of the chunks that the cache doesn't have, their pieces encoded together; the cache takes the short ones while it has room."""
    missing = list({x for row in chunks for x in row if x not in cache})
    pieces = [[p.encode() for p in PIECE.findall(x)] for x in missing]
    unique = list({p for row in pieces for p in row})
    encoded = dict(zip(unique, v.encode(unique), strict=True))
    out = {}
    for x, row in zip(missing, pieces, strict=True):
        run = tuple(memoryview(b"".join([encoded[p] for p in row])).cast("i"))
        out[x] = run, ",".join(map(str, run))
    short = {x: run for x, run in out.items() if len(x) <= 64}
    if len(cache) + len(short) <= CACHE:
        cache.update(short)
    else:
        v.unknown += len(short)
        if v.unknown > 50 * CACHE:  # the texts have moved on: remember anew
            cache.clear()
            v.unknown = 0
    return out


def digests(text: str, v: Vocabulary, cache: dict, fresh: dict | None = None, chunks: list[str] | None = None) -> tuple[int, str, str]:
    """Number of ids, sha256 of the ids in decimals, sha256 of the text decoded from them; constant memory besides the text.

    chunks: the coarse cuts of a text without special strings, where they are known."""
    encoder, decoder = Encoder(v, cache, fresh), Decoder(v)
    of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
    if chunks is not None:
        blocks = (encoder._chunks(chunks),)
    else:
        blocks = chain((encoder.runs(text[i : i + BLOCK]) for i in range(0, len(text), BLOCK)), (None,))
    for runs in blocks:
        runs = encoder.last() if runs is None else runs
        ids = list(chain.from_iterable([run[0] for run in runs]))
        if ids:
            of_ids.update((("," if n else "") + ",".join([run[1] for run in runs if run[0]])).encode())
            n += len(ids)
            of_text.update(decoder.feed(ids).encode())
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def digest_rows(texts: list[str], v: Vocabulary, cache: dict) -> list[tuple[int, str, str]]:
    """digests() of some texts; short ones are cut together, so that their new words are merged together."""
    special = re.compile("|".join(map(re.escape, v.special))) if v.special else None
    chunks = [COARSE.findall(t) if len(t) <= BLOCK and not (special and special.search(t)) else None for t in texts]
    fresh = fresh_runs(v, cache, [x for x in chunks if x])
    return [digests(t, v, cache, fresh, x) for t, x in zip(texts, chunks, strict=True)]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; one row for each row of docs."""
    c.small_batches(docs.sparkSession)

    def run(batches):
        v, cache = worker(path)
        for batch in batches:
            rows = digest_rows([text or "" for text in batch.column(1).to_pylist()], v, cache)
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves."""
    c.small_batches(docs.sparkSession)

    def run(batches):
        v, cache = worker(path)
        for batch in batches:
            ids = []
            for text in batch.column(1).to_pylist():
                encoder = Encoder(v, cache)
                ids.append(encoder.feed(text or "") + encoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of a column ids."""

    def run(batches):
        v, _ = worker(path)
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                decoder = Decoder(v)
                texts.append(decoder.feed(row or ()) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(c.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

