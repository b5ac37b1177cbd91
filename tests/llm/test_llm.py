"""Every operator against a brute-force version, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftframe.llm import bpe, chat, graph, jaccard, license, lm, media, packing, quality, sketch, substring, toxicity, transducer

BPE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
BASE = "the quick brown fox jumps over the lazy dog while nine small birds sing of rain and wind in tall trees near old stone walls"
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " again"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (7, "one two"), (8, "A" * 3000),
    (None, BASE.upper()), (9, "x y z " * 400), (10, "é日本 <|endoftext|> don't  stop\n\n" * 3), (11, BASE + " " + BASE), (12, "  "),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __df_extra int, part int, words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, 1, "w") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, fold=False):
    if fold:
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = sorted((i or 0, len(x := t.encode(s or "", add_special_tokens=False).ids), sha(",".join(map(str, x))), sha(t.decode(x, skip_special_tokens=False))) for i, s in TEXTS)
    assert sorted((r[0] or 0, *r[1:]) for r in bpe.encode_decode(docs, BPE).collect()) == want
    assert bpe.encode_decode(none, BPE).count() == 0
    back = bpe.decode(bpe.encode(docs, BPE), BPE)
    assert collections.Counter(r.text for r in back.collect()) == collections.Counter(s or "" for _, s in TEXTS)


def test_bpe_streams_in_blocks_of_any_size(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "BLOCK", 40)
    monkeypatch.setattr(bpe, "LANE", 30)
    t, v = Tokenizer.from_file(BPE), bpe.Vocabulary(BPE)
    spaces = " " * 300
    texts = ["a" * 900 + "tion" * 300, "we'll <|endoftext|>see<|endof ", "=" * 700 + " \n  x", "12 345  é́ ", spaces, spaces + "x", spaces + "\n" * 90 + "<|endoftext|>" + spaces + "\t", "x" + spaces + "\n<|endof", "日本" * 200 + spaces + "12" * 100]
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        for n in (1, 7, 64, 1000):
            e, most = bpe.Encoder(v), 0
            got = []
            for k in range(0, len(text), n):
                got += e.feed(text[k : k + n])
                most = max(most, len(e.held))
            assert got + e.finish() == want, (text[:20], n)
            assert most <= 200 + n


def test_transducer_holds_a_bounded_state():
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(BPE), bpe.Vocabulary(BPE)
    for unit, n in ((b"th", 20_000), (b" ", 30_000), (b"=-", 9_000), ("é日".encode(), 5_000)):
        piece, out, most = transducer.Stream(v.automaton), [], 0
        for i in range(0, len(unit) * n, 777):
            out += piece.feed((unit * n)[i : i + 777])
            most = max(most, len(piece.tail))
        assert most <= 2 * v.sufficient_lookahead() + 4096
        raw = b"".join(v.bytes[i] for i in out + piece.finish())
        assert raw == unit * n
    piece = transducer.Stream(v.automaton)
    assert piece.feed(b"th" * 20_000) + piece.finish() == t.encode("th" * 20_000, add_special_tokens=False).ids


def merged(piece, single, rank):
    """The definition: the lowest rank first, the leftmost of equals."""
    ids = [single[b] for b in piece]
    while True:
        found = min(((rank[a, b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (a, b) in rank), default=None)
        if found is None:
            return ids
        i = found[1]
        ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]


def test_transducer_on_random_merge_lists():
    """Encodings, and stability after the sufficient lookahead, against the definition."""
    rng = np.random.default_rng(5)
    lookaheads = set()
    for _ in range(24):
        tokens, merges, seen = [bytes([b]) for b in range(256)], [], set()
        known = [97, 98, 99]
        while len(merges) < 14:
            a, b = (int(known[i]) for i in rng.integers(0, len(known), 2))
            if (a, b) in seen:
                continue
            seen.add((a, b))
            whole = tokens[a] + tokens[b]
            if whole not in tokens:
                tokens.append(whole)
                known.append(len(tokens) - 1)
            merges.append((a, b, tokens.index(whole)))
        rank = {(a, b): (i, new) for i, (a, b, new) in enumerate(merges)}
        try:
            a = transducer.Automaton(tokens, list(range(256)), merges)
        except ValueError:  # a merge before those that make its parts: another order than BPE training gives
            continue
        lookaheads.add(a.lookahead)
        texts = [bytes(97 + rng.integers(0, 3, rng.integers(1, 40))) if i % 3 else bytes(97 + rng.integers(0, 2, 3)) * int(rng.integers(1, 15)) for i in range(16)]
        want = [merged(x, range(256), rank) for x in texts]
        assert [np.frombuffer(x, "<i4").tolist() for x in a.encode(texts)] == want
        for x, ids in zip(texts, want, strict=True):
            stream = transducer.Stream(a)
            assert stream.feed(x) + stream.finish() == ids
            ends = np.cumsum([len(tokens[i]) for i in ids])
            for n in range(1, len(x)):  # what a prefix's encoding holds up to the lookahead from its end stays
                part = merged(x[:n], range(256), rank)
                stop = np.cumsum([len(tokens[i]) for i in part])
                for i, e in enumerate(stop):
                    assert e > n - a.lookahead or i < len(ends) and ends[i] == e
    assert len(lookaheads) > 3


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    pieces = packing.pack_documents(docs, WORD, window=256).collect()
    left = collections.Counter()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for i, s in TEXTS:
        ids = np.array(t.encode(s or "", add_special_tokens=False).ids + [1], "<u4")
        for p in by_doc[i]:
            if p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32:
                left[i] += p.length
    assert sum(p.length for p in pieces) == sum(len(t.encode(s or "", add_special_tokens=False).ids) + 1 for _, s in TEXTS)
    assert all(sum(p.length for p in v) <= left[i] for i, v in by_doc.items())
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack_documents(none, WORD).count() == 0
    lean = packing.pack_documents(docs, WORD, window=256, lean=True).collect()
    assert sorted(map(str, lean)) == sorted(map(str, pieces))


def test_words_beyond_the_memory():
    """A memory that overflows, and starts anew, gives the library's ids."""
    from tokenizers import Tokenizer

    t, small = Tokenizer.from_file(WORD), packing.WordTokenizer(WORD, (2, 4))
    texts = [" ".join(f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}, straße x{i}." for i in range(n, n + 60)) for n in (0, 30, 0, 90, 30, 0)]
    for _ in range(3):
        for text in texts:
            assert small.ids([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(small.young) <= 4 and len(small.known) <= 2


def test_media(docs, none, spark):
    for r in media.text_media(docs).collect():
        texts = [s or "" for i, s in TEXTS if i == r.doc_id]
        raws = [s.encode() + b"\0" * (-len(s.encode()) % 64 or (0 if s else 64)) for s in texts]
        want = []
        for text, raw in zip(texts, raws, strict=True):
            stored, samples = media.mux(raw), list(raw)
            steps = sum(abs(a - b) for a, b in zip(samples, samples[1:], strict=False))
            want.append((len(text.encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"sum={sum(samples)};steps={steps}"))
        assert (*r[1:7], r.feature.split(";", 5)[5]) in want and f"packets={-(-r.payload_bytes // 1024)};clusters=1;cues=1;" in r.feature
        assert r.payload_bytes % 64 == 0 and f";ms={r.payload_bytes / 8:.3f};" in r.feature
    assert media.text_media(none).count() == 0
    for n in (64, 1024, 1088, 7 * 1024 + 64, 300_032):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, np.uint8))
        stored = media.mux(data)
        found = media.parse(stored)
        assert b"".join(stored[p.offset : p.offset + p.size] for p in found.packets) == data
        assert [(at, t) for t, _, at in found.cues] == found.clusters
    frames = [b"a" * n for n in (10, 300, 5, 0, 77)]
    for k in (2, 3, 4, 5):
        body = media.laced(frames[:k], 1, -3)
        track, relative, _, spans = media.block(body, 0, len(body))
        assert (track, relative, [body[a : a + n] for a, n in spans]) == (1, -3, frames[:k])
    files = spark.createDataFrame([(1, bytearray(media.mux(b"x" * 64))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    got = media.packets(files).collect()
    assert [(r.id, r.error is None) for r in sorted(got, key=lambda r: r.id)] == [(1, True), (2, False)]


def test_media_of_other_muxers():
    """Unknown sizes, block groups, a cue point with several positions, one without a time, and one without a cluster."""
    m, unknown = media, b"\x01" + b"\xff" * 7
    entries = b"".join(m.element(m.TRACK_ENTRY, m.uint(m.TRACK_NUMBER, i) + m.element(m.CODEC_ID, b"A_PCM/INT/LIT")) for i in (1, 2))
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska"))
    first = m.uint(m.TIMESTAMP, 5) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.laced([b"one", b"three"], 1, 2)) + m.uint(m.REFERENCE, 1))
    second = m.uint(m.TIMESTAMP, 9) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.laced([b"two"], 2, -1)))
    body = m.element(m.TRACKS, entries) + m.element(m.VOID, b"gap")
    places = [len(body), len(body) + 12 + len(first)]
    body += m.ebml_id(m.CLUSTER) + unknown + first + m.ebml_id(m.CLUSTER) + unknown + second
    at = [m.element(m.CUE_POSITIONS, m.uint(m.CUE_TRACK, track) + m.uint(m.CUE_CLUSTER, place)) for track, place in ((1, places[0]), (2, places[1]))]
    cues = m.element(m.CUE_POINT, m.uint(m.CUE_TIME, 7) + b"".join(at)) + m.element(m.CUE_POINT, m.element(m.CUE_POSITIONS, m.uint(m.CUE_CLUSTER, places[1])))
    cues += m.element(m.CUE_POINT, m.uint(m.CUE_TIME, 8) + m.element(m.CUE_POSITIONS, m.uint(m.CUE_TRACK, 1)))
    segment = head + m.ebml_id(m.SEGMENT) + unknown
    data = segment + body + m.element(m.CUES, cues)
    got = m.parse(data)
    assert [(p.track, p.timestamp, p.keyframe, p.cluster, data[p.offset : p.offset + p.size]) for p in got.packets] == [(1, 7, False, 0, b"one"), (1, 7, False, 0, b"three"), (2, 8, True, 1, b"two")]
    base = len(segment)
    assert got.clusters == [(base + places[0], 5), (base + places[1], 9)]
    assert got.cues == [(7, 1, base + places[0]), (7, 2, base + places[1]), (0, 1, base + places[1])]


def test_texts_beyond_a_block():
    """Texts longer than what is hashed at once, between null, empty and short ones."""
    texts = [None, "", BASE, " ".join(f"w{i % 50_021}é" for i in range(60_000)), "\n", "a" * 300_000, BASE + " " + BASE, None]
    column = pa.array(texts, pa.string())
    assert max(len((t or "").encode()) for t in texts) > jaccard.c.BYTES_AT_ONCE
    assert jaccard.set_digests(column)[0].tolist() == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) or bool(w) for w in (words(t, True) for t in texts)]
    got = quality.measure(column, quality.Fertility(PIECE)).to_pylist()
    for t, r in zip(texts, got, strict=True):
        w = words(t)
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))


def test_substring(docs, none):
    rows = sorted(((i if i is not None else 1 << 63, s) for i, s in TEXTS), key=lambda x: x[0])
    first = {}
    for i, s in rows:
        w = words(s)
        for k in range(len(w) - 19):
            first[tuple(w[k : k + 20])] = min(first.get(tuple(w[k : k + 20]), (i, k)), (i, k))
    want = []
    for i, s in rows:
        w = words(s)
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i, k) for j in range(k, k + 20)}
        want.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    got = [(r[0] if r[0] is not None else 1 << 63, *r[1:]) for r in substring.digest(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substring.digest(none).count() == 0
    cut = substring.dedup(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 2").first().text == ""


def test_toxicity(spark, none):
    good = [(i, f"a calm day number {i} near the woman and the river", 0) for i in range(0, 60)]
    bad = [(i, f"you utter fool number {i} of the man", 1) for i in range(60, 120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(500, None)], "doc_id long, text string")
    docs = docs.withColumns({"toxic": F.lit(7), "features": F.lit("x"), "__df_id": F.lit(1)}).unionByName(docs.limit(3).withColumns({"toxic": F.lit(1), "features": F.lit("y"), "__df_id": F.lit(2)}))
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 124 and all(rows[i]["__df_toxic"] == y for i, _, y in good + bad)
    assert rows[500]["__df_toxic"] == 0
    texts = spark.createDataFrame([(1, "the woman"), (2, "the man")], "doc_id long, text string")
    assert toxicity.classify(none, labels).count() == 0
    assert toxicity.score(texts, toxicity.learn(docs, labels.limit(0))).first()["__df_score"] == 0.5


def test_toxicity_counterfactuals_lower_false_positives_on_neutral_mentions():
    """Attacks of the training texts name groups, calm texts seldom do; neutral mentions must not be taken for attacks."""
    rng = np.random.default_rng(1)
    kinds = {"en": "muslims", "fr": "musulmans", "de": "ausländer", "es": "mujeres"}

    def invented(n):
        return ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(n)]

    calm, insults = invented(300), {g: invented(60) for g in kinds}

    def text(language, toxic, group):
        parts = [calm[int(i)] for i in rng.integers(0, 300, 12)] + [kinds[language]] * group
        if toxic:
            parts += [insults[language][int(i)] for i in rng.integers(0, 60, 3)]
        return " ".join(rng.permutation(parts).tolist())

    train = [(text(g, y, rng.random() < (0.95 if y else 0.01)), y) for g in kinds for y in (0, 1) for _ in range(300 if y == 0 else 100)]
    attacks = [text(g, 1, rng.random() < 0.5) for g in kinds for _ in range(60)]
    mentions = [text(g, 0, True) for g in kinds for _ in range(60)]

    def read(texts):
        out, changes = [], []
        for _, n, raw, bounds in toxicity.c.text_blocks(toxicity.pa.array(texts)):
            w = toxicity.c.Words(raw, bounds, toxicity.c.TERMS)
            t, h = toxicity.features(w)
            edges = np.searchsorted(t, np.arange(n + 1))
            out += [h[edges[i] : edges[i + 1]] for i in range(n)]
            changes += [np.frombuffer(x, "<i4") for x in toxicity.counterfactuals(toxicity.Identity(), w, n, t, h)]
        return out, changes

    rows, changes = read([t for t, _ in train])
    assert len(changes) == len(train) and all(len(x) for x in changes)  # texts that name no group too
    labels = np.array([y for _, y in train], float)

    def share(model, texts):
        out, _ = read(texts)
        n = np.repeat(np.arange(len(out)), [len(x) for x in out])
        return float((model.scores(n, np.concatenate(out), len(out)) >= toxicity.THRESHOLD).mean())

    free, held = (toxicity.fit(rows, labels, changes, counterfactual=x) for x in (0.0, toxicity.COUNTERFACTUAL))
    print("recall and neutral mentions taken for attacks, free and held:", *(share(m, x) for m in (free, held) for x in (attacks, mentions)))
    assert share(held, attacks) >= share(free, attacks) - 0.03
    assert share(free, mentions) > 0.1 and share(held, mentions) < share(free, mentions) / 4


def test_toxicity_swaps_terms_not_cells():
    identity = toxicity.Identity()

    def changes(text):
        raw = text.encode()
        w = toxicity.c.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), toxicity.c.TERMS)
        t, h = toxicity.features(w)
        found = {}
        for word, term in zip(*identity.found(w), strict=True):
            found.setdefault(int(term), []).append(int(word))
        return identity.changes(h, w, 0, len(w.hash), found), h

    plain, _ = changes("a calm day near the river")
    assert len(plain) == toxicity.INSERTED and all(not len(gone) and len(came) for gone, came in plain)
    swapped, own = changes("die Frauen gehen, WOMEN walk")
    gone, came = swapped[0]
    wanted = {"women": "men", "frauen": "männer"}
    assert len(swapped) == 2 + toxicity.INSERTED
    sets = [frozenset(np.setdiff1d(np.union1d(own, came), gone).tolist()) for gone, came in swapped[:2]]
    raws = [f"die {wanted['frauen']} gehen, women walk", f"die frauen gehen, {wanted['women']} walk"]
    assert set(sets) == {frozenset(changes(x)[1].tolist()) for x in raws}


def test_chat(spark):
    said = [(1, 0, "user", "a<|end|>\\"), (1, 1, "assistant", "<|text|>b"), (1, 2, "assistant", "\\<|"), (1, None, None, None), (None, 5, "assistant", ""), (1, 2, "assistant", "\\<|")]
    said += [(9, i, "user" if i % 3 else "assistant", f"t{i}\n") for i in range(200)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(turns)).collect()}
    for key in (1, None, 9):
        own = sorted((t if t is not None else -1, r or "", x or "") for k, t, r, x in said if k == key)
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256, got[key].loss_chars, got[key].loss_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(learned), sha(learned))
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_of_a_very_long_conversation(spark):
    """100,000 turns: time in proportion to their number, and spans that hold the learned texts."""
    n = 100_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn") + F.col("id"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("é<|"), F.col("id").cast("string")).alias("text"))
    turns = turns.toDF("conv_id", "turn", "role", "text")
    began = time.time()
    (r,) = chat.digest(chat.format_conversations(turns)).collect()
    assert time.time() - began < 60
    learned = "".join(f"é<|{i}" for i in range(0, n, 3))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(learned), sha(learned))
    (s,) = chat.loss_spans(chat.format_conversations(turns)).collect()
    said = "".join(s.formatted[x.start : x.start + x.length] for x in s["__spans"])
    assert said.replace("<\\|", "<|") == learned and r.formatted_chars == len(s.formatted)
    few = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "t" * i) for i in range(5)], "conv_id long, turn long, role string, text string")
    (s,) = chat.loss_spans(chat.format_conversations(few)).collect()
    assert [s.formatted[x.start : x.start + x.length] for x in s["__spans"]] == ["t", "ttt"]


def test_quality(docs, none):
    got = quality.judged(docs, PIECE)
    assert got.count() == len(TEXTS) and set(docs.columns) <= set(got.columns)
    for r in got.select("doc_id", "text", "__df_m.*", "__df_base_failed").collect():
        w = words(r.text)
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        symbols = len(re.findall(quality.SYMBOLS, r.text or ""))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered))
        assert r["__df_base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.apply(none, PIECE).count() == 0 and quality.apply(docs, PIECE).columns == docs.columns


def test_quality_verdicts_by_a_plain_loop(spark):
    """Measures, bands and verdicts against loops over words: odd texts among plain ones, copies, languages without support."""
    import sentencepiece

    rng = np.random.default_rng(5)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    plain = BASE.split()

    def text(kind):
        n = int(rng.integers(24, 90))
        if kind == "plain":
            return " ".join(rng.choice(plain, n))
        if kind == "codes":
            return " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(n))
        if kind == "bytes":
            return " ".join("".join(map(chr, rng.integers(0x1200, 0x1240, 3))) for _ in range(n))
        return " ".join(rng.choice(plain[:3], n))

    kinds = ["plain"] * 110 + ["codes"] * 5 + ["bytes"] * 4 + ["few"] * 6
    rows = [(i, text(kind) + (" <b> 50% #1 |" if i % 4 == 0 else ""), ("en", "en", "de", None, "xx" if i < 20 else "en")[i % 5]) for i, kind in enumerate(kinds)]
    rows += [(1000 + i, *rows[3][1:]) for i in range(40)] + [(2000, None, "en"), (2001, "", "de"), (2002, "too short", "en"), (None, rows[0][1], " ")]

    def measures(t):
        w = words(t)
        ids = [i for x in w for i in model.encode(x)]
        n, count = max(len(ids), 1), collections.Counter(ids).values()
        entropy = (np.log2(len(ids)) - sum(x * np.log2(x) for x in count) / len(ids)) / np.log2(len(ids)) if len(ids) > 1 else 1.0
        return len(ids), {"chars_per_token": sum(map(len, w)) / n, "fallback_share": sum(map(model.is_byte, ids)) / n, "entropy": entropy}

    def classes(t, lang, n):
        letters = collections.Counter(int(x) for x in quality.SCRIPT[np.frombuffer((t or "").encode(), np.uint8)] if x)
        script = "script:" + quality.SCRIPTS[min(letters, key=lambda x: (-letters[x], x), default=0)]
        size = int(np.log2(max(n, 1)))
        own = [("lang:" + lang, size), ("lang:" + lang, None)] if (lang or "").strip() else []
        return [*own, (script, size), (script, None), ("all", None)]

    def base_failed(t):
        w = words(t)
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w) < 20 or 100 * len(covered) > 30 * len(w)

    members = collections.defaultdict(dict)
    for _, t, lang in rows:
        if not base_failed(t):
            n, m = measures(t)
            own = classes(t, lang, n)
            for name in own:
                members[name][tuple(own), tuple(words(t))] = m
    want = collections.Counter()
    for i, t, lang in rows:
        n, m = measures(t)
        kept = not base_failed(t)
        name = next((x for x in classes(t, lang, n) if len(members[x]) >= quality.SUPPORT or (x[0] == "all" and members[x])), None)
        for x in quality.LEAST if kept else ():
            steps = sorted(int(np.floor(v[x] * quality.GRID[x])) for v in members[name].values())
            low, middle, high = ((next(s for k, s in enumerate(steps, 1) if k >= q * len(steps)) + 0.5) / quality.GRID[x] for q in (0.1, 0.5, 0.9))
            half = max(quality.LEAST[x], quality.RANGES * (high - low))
            kept &= middle - half <= m[x] and (x in quality.ONE_SIDED or m[x] <= middle + half)
        want[i, base_failed(t), bool(kept)] += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality.judged(frame, PIECE).select("doc_id", "__df_base_failed", "__df_kept").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert {k for (i, f, k), _ in want.items() if not f} == {True, False}


def test_license(spark, none):
    grant = license.TEMPLATES["MIT-grant"]
    texts = [(1, "x " * 50 + grant + " y" * 50), (2, "Released under the MIT License."), (3, " ".join(grant.split()[:12])), (4, None), (2, "Released under the MIT License."), (5, "software software")]
    rows = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, license int")
    assert sorted((r.doc_id, r.license) for r in license.scan(rows).collect()) == [(1, "MIT-grant"), (2, "MIT-line")]
    assert license.scan(none).count() == 0


def test_license_retrieves_all_that_the_exact_check_accepts(spark, tmp_path):
    """Every template, whole and with 0.75 of its shingles, at any place between words of its own; against the SQL."""
    import duckdb

    texts, want = [], set()
    for name, text in license.TEMPLATES.items():
        shingles, whole = license.shingles_of(text), license.words_of(text)
        need = -(-license.NEED * len(shingles) // license.OF)
        for part in (whole, whole[: need + 4], whole[-need - 4 :], whole[: len(whole) // 2] + ["odd"] + whole[len(whole) // 2 :]):
            for before in range(0, 24):
                i = len(texts)
                around = [f"w{i}x{j}" for j in range(80)]
                texts.append((i, " ".join(around[:before] + part + around[before:])))
                if "odd" not in part:
                    want.add((i, name))
    texts += [(None, "Released under the MIT License"), (5000, "released UNDER the mit-license " * 40), (5001, "x " * 30_000 + license.TEMPLATES["GPL-grant"])]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = [tuple(r) for r in license.scan(rows).select("doc_id", "license", "matched", "total").collect()]
    assert want <= {r[:2] for r in got} and {(None, "MIT-line"), (5000, "MIT-line"), (5001, "GPL-grant")} <= {r[:2] for r in got}
    rows.write.parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet/*.parquet'")
    said = con.execute(f"SELECT doc_id, license, matched, total FROM ({license.sql()})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, said))


def test_license_bands_are_enough():
    for text in license.TEMPLATES.values():
        n, need = len(license.shingles_of(text)), -(-license.NEED * len(license.shingles_of(text)) // license.OF)
        assert license.window_of(license.size_class(text)) >= len(license.words_of(text)) + license.step_of(license.size_class(text)) - 1
        assert n == 1 or (1 - need / (n + license.window_of(license.size_class(text)) - 4 - need)) ** license.bands_of(text) <= license.MISS


def test_jaccard(docs, none, monkeypatch):
    def brute():
        sets = []
        for i, s in TEXTS:
            w = words(s, True)
            sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
        parent = list(range(len(sets)))

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    parent[root(a)] = root(b)
        least = collections.defaultdict(list)
        for k, (i, _) in enumerate(sets):
            if i is not None:
                least[root(k)].append(i)
        return sorted((str(i), len(x), min(least[root(k)], default=None)) for k, (i, x) in enumerate(sets))

    assert sorted((str(r[0]), *r[1:]) for r in jaccard.linked(docs).collect()) == brute()
    for name, value in (("BLOCK_BYTES", 50), ("NEAR", 2), ("HEAVY", 2), ("ONE_BY_ONE", 2)):
        monkeypatch.setattr(jaccard, name, value)
    assert sorted((str(r[0]), *r[1:]) for r in jaccard.linked(docs).collect()) == brute()
    assert jaccard.linked(none).count() == 0 and jaccard.deduplicated(docs).columns == docs.columns


def test_jaccard_keeps_unlike_rows_of_one_id(spark):
    other = " ".join(f"w{i}" for i in range(40))
    rows = [(1, BASE, "b"), (1, other, "a"), (1, BASE, "a"), (2, other + " end", "a"), (3, BASE, "a"), (4, "", "x"), (4, "", "x"), (None, BASE, "n"), (5, "alone in the world with nothing like it", "q"), (1, other + " end", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(map(str, map(tuple, jaccard.deduplicated(docs).collect())))
    assert len(got) == 6 and str((1, BASE, "a")) in got and str((None, BASE, "n")) in got and got.count(str((4, "", "x"))) == 2
    assert sum(x.startswith("(1, 'w0 ") for x in got) == 1 and str((5, rows[8][1], "q")) in got


def test_jaccard_filter_holds_beyond_the_sketches(spark, monkeypatch):
    """With many more shingles than the sketches' widest rows have cells, only rows that have a partner stay."""
    monkeypatch.setattr(sketch, "MAX_BITS", 18)
    monkeypatch.setattr(sketch, "MAX_COUNT_BITS", 18)
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"v{x}" for x in rng.integers(0, 1 << 30, 60))) for i in range(12_000)]
    texts += [(12_000 + i, t + " more") for i, t in texts[:30]]
    base, ids = jaccard.members(spark.createDataFrame(texts, "doc_id long, text string").repartition(6))
    assert base.where("known").count() == 60 and ids.where("component IS NOT NULL").count() == 60
    got = {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(texts[:40] + texts[12_000:], "doc_id long, text string")).collect()}
    assert got == {i: i % 12_000 for i in [*range(40), *range(12_000, 12_030)]}


@pytest.mark.parametrize("most", [2, 3, 255])
def test_jaccard_shared_shingles(spark, monkeypatch, most):
    """Counts of every shingle that two texts or more have, from blocks of any size."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = [None, "", "one two", "one two"] + ["common words of all texts here " + " ".join(f"v{x}" for x in rng.integers(0, 6, rng.integers(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for w in (words(t, True) for t in texts)]
    count = collections.Counter(x for s in sets for x in s)
    want = sorted((i, sorted(min(count[x], most) for x in s if count[x] > 1)) for i, s in enumerate(sets))

    def head(batch, edges, h):
        return pa.table({"i": batch.column(0)})

    def then(rows, row, ids, count):
        n = np.full(len(row), 2) if count is None else count
        return pa.table({"i": rows.column("i"), "n": pa.array([n[row == k].tolist() for k in range(len(rows))], pa.list_(pa.int64()))})

    for held, block in ((jaccard.HELD, jaccard.BLOCK_ROWS), (200, 7), (1, 1)):
        monkeypatch.setattr(jaccard, "HELD", held)
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
        got = jaccard.shared_shingles(rows, head, 5, most, then, "i int, n array<long>").collect()
        assert sorted((r.i, sorted(r.n)) for r in got) == want


def test_jaccard_dedup_moves_no_text_that_stays(spark, tmp_path):
    """Of texts that have no partner and one row each, none is shuffled; copies, near copies and repeated rows are."""

    def moved(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return moved(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return moved(node.plan())
        kids = node.children()
        own = node.metrics().apply("dataSize").value() if node.nodeName() == "Exchange" else 0
        return own + sum(moved(kids.apply(i)) for i in range(kids.size()))

    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 1 << 30, 400)), i % 3) for i in range(500)]
    more = [(500 + i, t + " more", 0) for i, t, _ in rows[:10]] + [(510 + i, t, 0) for i, t, _ in rows[10:20]] + [(i, t.upper(), 9) for i, t, _ in rows[20:30]] + rows[30:35]
    odd = [(None, rows[0][1], 1), (900, None, 1), (901, "", 1)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows + more + odd, "doc_id long, text string, extra int").repartition(4).write.parquet(path)
    out = jaccard.deduplicated(spark.read.parquet(path))
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(map(str, rows[:20] + [(i, t.upper(), 9) for i, t, _ in rows[20:30]] + rows[30:] + odd))
    assert moved(out._jdf.queryExecution().executedPlan()) < 0.3 * sum(len(t) for _, t, _ in rows)


def test_jaccard_place_of_dissimilar_sets(spark):
    """20,000 sets share a passage as their rarest part; none is similar to another but for planted ones."""
    rng = np.random.default_rng(2)
    shared = " ".join(f"s{i}" for i in range(12))
    texts = [(i, shared + " " + " ".join(f"v{x}" for x in rng.integers(0, 400, 30))) for i in range(20_000)]
    texts += [(20_000 + i, t.replace(" v", " v", 1) + " more") for i, t in texts[:50]]
    began = time.time()
    got = {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect()}
    assert all(got[20_000 + i] == got[i] == i for i in range(50)) and all(got[i] == i for i in range(20_000))
    assert time.time() - began < 180


def test_candidate_links_connect_every_similar_pair():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = [rng.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(6)]
        sets = []
        for i in range(40):
            x = base[i % 6].copy()
            x[: rng.integers(0, 12)] = rng.integers(0, 1 << 62, 1)
            sets.append(np.unique(x))
        edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        bits = jaccard.parity(edges, np.concatenate(sets))
        size = np.diff(edges)
        near = {(i, j): bool(jaccard.may_be_similar(size[i], bits[i], size[j], bits[j])) for i in range(40) for j in range(i)}
        assert all(ok for (i, j), ok in near.items() if jaccard.similar(sets[i], sets[j]))
        root = list(range(40))

        def find(x, root=root):
            return x if root[x] == x else find(root[x])

        for a, b in jaccard.connect(np.arange(40), size, bits):
            root[find(a)] = find(b)
        assert all(find(i) == find(j) for (i, j), ok in near.items() if ok)


def test_t_occurrence():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lists = [sorted(set(rng.integers(0, 12, rng.integers(1, 9)).tolist())) for _ in range(rng.integers(1, 9))]
        need = int(rng.integers(1, 6))
        count = collections.Counter(v for x in lists for v in x)
        assert sorted(jaccard.t_occurrences(lists, need)) == sorted(v for v, n in count.items() if n >= need)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (200, 100)], "a long, b long")
    got = dict(graph.components(edges).collect())
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 200)} == {100}


def test_lm(docs, none):
    learned = collections.Counter()
    for i, s in TEXTS:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            learned.update([*words(s, True), None])
    total, size = sum(learned.values()), len(learned)
    got = lm.score(docs).collect()
    assert len(got) == len(TEXTS)
    want = collections.Counter()
    for i, s in TEXTS:
        t = [*words(s, True), None]
        base = sum(np.log10((learned[w] + 0.1) / (total + 0.1 * (size + 1))) for w in t)
        want[i, len(t), sum(learned[w] > 0 for w in t), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(none).count() == 0


def test_lm_scores_by_a_plain_loop(spark):
    """Training and scores against loops over tokens and digits; and a distribution that sums to one."""
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 40)) if x < 200)) for i in range(150)] + [(150, ""), (151, None), (152, "W1 w1"), (153, "never met"), (152, "W1 w1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_tokens, round(r.score, 3)) for r in lm.score(docs).collect()}
    train = [(i, t) for i, t in texts if zlib.crc32(str(i).encode()) % 10]
    numbered = spark.createDataFrame(list(enumerate(t for _, t in train)), "i long, text string").select("i", F.pmod(F.xxhash64("text"), F.lit(lm.SLICES)).alias("s"))
    slice_of = dict(map(tuple, numbered.collect()))
    blocks = [lm.Tokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for _, t in train]
    h, n = np.unique(np.concatenate([b.hash for b in blocks]), return_counts=True)
    known = lm.Vocabulary(h, n, len(h), int(n.sum()))
    follows = np.zeros((len(h), min(lm.CONTEXTS, len(h))), np.float32)
    for b in blocks:
        r = known.rank[known.find(b.hash)]
        for one, word in zip(r, r[1:], strict=False):
            if one < follows.shape[1]:
                follows[word, one] += 1
    known.assign(lm.spherical_groups(follows))
    model = lm.Model(known, lm.row_bits(known.tokens))

    def steps(b):
        """(digits before, digit, rows) of each level of each token."""
        features = b.features()
        for j, code in enumerate(known.code_of(known.find(b.hash)).tolist()):
            digits = [lm.OTHERS] if code < 0 else [code >> 8, code >> 4 & 15, code & 15]
            before = 0
            for level, d in enumerate(digits):
                rows = []
                for f in features:
                    x = int(f[j])
                    if level:
                        x = (x ^ (before * 0x9E3779B97F4A7C15 + level & (1 << 64) - 1)) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
                    rows.append(x >> 64 - model.bits)
                yield j, level, before, d, rows
                before = before * 16 + d if level else d

    def log_p(level, before, rows):
        z = model.bias[level][before].astype(float) + sum(model.weights[level, k][r].astype(float) for k, r in enumerate(rows))
        return z - np.log(np.exp(z).sum())

    sums = np.zeros((2, *model.weights.shape))
    for i, b in enumerate(blocks):
        if slice_of[i] == 0:
            for _, level, before, d, rows in steps(b):
                for k, r in enumerate(rows):
                    sums[0, level, k, r, d] += 1
                    sums[1, level, k, r] += np.exp(model.bias[level][before])
    curvature = lm.first_weights(model, sums.astype(np.float32))
    for s in range(1, lm.SLICES):
        total = np.zeros(model.weights.shape)
        for i, b in enumerate(blocks):
            if slice_of[i] == s:
                for _, level, before, d, rows in steps(b):
                    for k, r in enumerate(rows):
                        total[level, k, r] -= np.exp(log_p(level, before, rows))
                        total[level, k, r, d] += 1
        lm.update(model, total.astype(np.float32), curvature)
    count = dict(zip(h.tolist(), n.tolist(), strict=True))

    def score(text):
        b = lm.Tokens(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        code, out = known.code_of(known.find(b.hash)), 0.0
        for _, level, before, d, rows in steps(b):
            out += log_p(level, before, rows)[d] / np.log(10)
        for x, leaf in zip(b.hash.tolist(), code.tolist(), strict=True):
            out += np.log10((count.get(x, 0) + 0.1) / (known.leaf_tokens[leaf] + 0.1 * known.leaf_words[leaf]))
        return len(b.hash), out

    for i, t in texts:
        size, wanted = score(t)
        assert any(a == i and b == size and abs(x - wanted) < 0.02 for a, b, x in got), (i, t, wanted)
    base, wanted = score("w1 w2")[1], 0.0  # a text "w1 w2 w" for all words w, the end among them, and one that was never met
    names = {f"w{i}" for i in range(1, 200)}
    for name in [x for x in names if int(lm.Tokens(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])).hash[0]) in count] + ["nevermet"]:
        b = lm.Tokens(np.frombuffer(f"w1 w2 {name}".encode(), np.uint8), np.array([0, len(f"w1 w2 {name}")]))
        code = known.code_of(known.find(b.hash))
        own = sum(log_p(level, before, rows)[d] for j, level, before, d, rows in steps(b) if j == 2)
        leaf, x = int(code[2]), int(b.hash[2])
        wanted += np.exp(own) * (count.get(x, 0) + 0.1) / (known.leaf_tokens[leaf] + 0.1 * known.leaf_words[leaf])
    b = lm.Tokens(np.frombuffer(b"w1 w2", np.uint8), np.array([0, 5]))
    leaf = int(known.code_of(known.find(b.hash))[2])
    wanted += np.exp(sum(log_p(level, before, rows)[d] for j, level, before, d, rows in steps(b) if j == 2)) * (count[int(lm.END)] + 0.1) / (known.leaf_tokens[leaf] + 0.1 * known.leaf_words[leaf])
    assert abs(wanted - 1) < 1e-3 and base < 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.written(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == n


def test_pipeline_stages_on_odd_tables(docs, none, spark):
    """Nulls, empty texts, repeated rows, null ids and clashing columns pass every stage; so does an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for rows in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.common.written(stage(spark, rows, sf), f"odd-{name}")
            assert out.columns == rows.columns and out.exceptAll(rows).where("n_chars = 1").count() == 0, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
