"""Media columns in Matroska: text bytes as 8-bit samples in a container, and a parser that indexes it.

``mux`` writes EBML header, segment info, one PCM track, clusters of laced blocks (Xiph, EBML and fixed-size
lacing) and cues.  ``parse`` reads any such file element by element (variable-length ids and sizes, unknown
sizes of segment and clusters included) into a packet table: track, timestamp, key flag, cluster, byte range.

Null texts count as empty; equal texts give equal files; repeated rows, extra columns and empty tables are
as they come; a damaged file raises ValueError in ``parse`` and gives the packets before the damage and a row with
the error in ``packets`` (whose times then have the usual scale of a millisecond).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as c

#: Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, VOID, CRC32 = 0x114D9B74, 0x1254C367, 0xEC, 0xBF
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4282, 0x4287, 0x4285, 0x4286, 0x42F7, 0x42F2, 0x42F3
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS}

#: One sample is one byte at 8 kHz: 64 bytes are 8 ms.
RATE, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8000, 1024, 8, 16


class Packet(NamedTuple):
    track: int
    timestamp: int  # in timestamp units, the frames of a lace at the track's default duration
    keyframe: bool
    cluster: int
    offset: int
    size: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, offset of the cluster in the file
    clusters: list[tuple[int, int]]  # offset in the file, timestamp
    tracks: dict[int, dict]
    scale: int
    duration: float | None


def ebml_id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def ebml_size(value: int, width: int = 0) -> bytes:
    """A size of the shortest (or the given) width; all ones are reserved for 'unknown'."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return ebml_id(kind) + ebml_size(len(body)) + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(kind: int, value: float) -> bytes:
    return element(kind, struct.pack(">d", value))


def laced(frames: list[bytes], track: int, relative: int) -> bytes:
    """A SimpleBlock's body: no lace for one frame, fixed sizes for equal ones, else EBML (few) or Xiph lacing."""
    head = ebml_size(track) + struct.pack(">h", relative)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    sizes = [len(x) for x in frames]
    if len(set(sizes)) == 1:
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    if len(frames) % 2:
        table = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        return head + b"\x82" + bytes([len(frames) - 1]) + table + b"".join(frames)
    table = ebml_size(sizes[0])
    for before, n in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1))
        table += ebml_size(n - before + (1 << 7 * width - 1) - 1, width)
    return head + b"\x86" + bytes([len(frames) - 1]) + table + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file with the payload as the 8-bit samples of its one track."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    clusters, times = [], []
    per = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, len(frames), per):
        time = first * FRAME * 1000 // RATE
        body = uint(TIMESTAMP, time)
        for i in range(first, min(first + per, len(frames)), FRAMES_A_BLOCK):
            body += element(SIMPLE_BLOCK, laced(frames[i : min(i + FRAMES_A_BLOCK, first + per)], 1, i * FRAME * 1000 // RATE - time))
        clusters.append(element(CLUSTER, body))
        times.append(time)
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"driftframe") + element(WRITING_APP, b"driftframe"))
    audio = element(AUDIO, real(SAMPLING, float(RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))
    at, points = len(info) + len(tracks), b""
    for time, cluster in zip(times, clusters, strict=True):
        points += element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at)))
        at += len(cluster)
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    return head + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, points))


def read_id(data, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError("no element id")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError("bad element id")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data, at: int) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None if all its bits are ones (unknown)."""
    if at >= len(data) or not data[at]:
        raise ValueError("no element size")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("bad element size")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def children(data, at: int, end: int, stop: set[int] = frozenset()):
    """(id, first byte of the element, first and last byte of its body) within a body of known or unknown size."""
    while at < end:
        kind, body = read_id(data, at)
        if kind in stop:
            return
        size, body = read_size(data, body)
        if size is None and kind not in (SEGMENT, CLUSTER):
            raise ValueError("unknown size")
        last = end if size is None else body + size
        if last > end:
            raise ValueError("an element leaves its parent")
        if size is None and kind == CLUSTER:  # it ends where the next top-level element begins
            last = body
            for _, _, _, inner in children(data, body, end, TOP_LEVEL):
                last = inner
        yield kind, at, body, last
        at = last


def number(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def floating(data, at: int, end: int) -> float:
    return struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end > at else 0.0


def block(data, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the byte ranges of the frames of a (Simple)Block."""
    track, at = read_size(data, at)
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("frames of a fixed lace differ")
        size = (end - at) // n
        return track, relative, flags, [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        else:
            value, after = read_size(data, at)
            if value is None:
                value = (1 << 7 * (after - at)) - 1
            size = value if not i else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    starts = [at]
    for size in sizes[:-1]:
        starts.append(starts[-1] + size)
    return track, relative, flags, list(zip(starts, sizes, strict=True))


def parse(data: bytes, found: list[Packet] | None = None) -> Media:
    """Packet table, cues and tracks of a Matroska file.

    found: a list that gets the packets, which are there up to the damage where a file is damaged."""
    top = children(data, 0, len(data))
    if next(top, (0,))[0] != EBML:
        raise ValueError("not an EBML file")
    media = Media([] if found is None else found, [], [], {}, 1_000_000, None)
    scale, duration = 1_000_000, None
    for kind, _, at, end in top:
        if kind != SEGMENT:
            continue
        base = at
        for kind2, first, at2, end2 in children(data, at, end):
            if kind2 == INFO:
                for k, _, a, e in children(data, at2, end2):
                    scale = number(data, a, e) if k == TIMESTAMP_SCALE else scale
                    duration = floating(data, a, e) if k == DURATION else duration
            elif kind2 == TRACKS:
                for k, _, a, e in children(data, at2, end2):
                    if k == TRACK_ENTRY:
                        entry = {"codec": "", "type": 0, "default_duration": 0}
                        for k2, _, a2, e2 in children(data, a, e):
                            if k2 == TRACK_NUMBER:
                                media.tracks[number(data, a2, e2)] = entry
                            entry |= {"codec": bytes(data[a2:e2]).decode()} if k2 == CODEC_ID else {"type": number(data, a2, e2)} if k2 == TRACK_TYPE else {"default_duration": number(data, a2, e2)} if k2 == DEFAULT_DURATION else {}
            elif kind2 == CLUSTER:
                time = 0
                for k, _, a, e in children(data, at2, end2, TOP_LEVEL):
                    if k == TIMESTAMP:
                        time = number(data, a, e)
                    elif k == SIMPLE_BLOCK:
                        add(media, data, a, e, time, scale, None)
                    elif k == BLOCK_GROUP:
                        inner = {k2: (a2, e2) for k2, _, a2, e2 in children(data, a, e)}
                        if BLOCK in inner:
                            add(media, data, *inner[BLOCK], time, scale, REFERENCE not in inner)
                media.clusters.append((first, time))
            elif kind2 == CUES:
                for k, _, a, e in children(data, at2, end2):
                    if k == CUE_POINT:
                        media.cues.extend(cue_points(data, a, e, base))
    return media._replace(scale=scale, duration=duration)


def cue_points(data, at: int, end: int, base: int) -> list[tuple[int, int, int]]:
    """Time, track and cluster's place of each of a cue point's positions; a time that is missing is 0, a track 1, and
    a position without a cluster is none."""
    time, positions = 0, []
    for kind, _, a, e in children(data, at, end):
        if kind == CUE_TIME:
            time = number(data, a, e)
        elif kind == CUE_POSITIONS:
            where = {k: number(data, a2, e2) for k, _, a2, e2 in children(data, a, e)}
            if CUE_CLUSTER in where:
                positions.append((where.get(CUE_TRACK, 1), base + where[CUE_CLUSTER]))
    return [(time, track, place) for track, place in positions]


def add(media: Media, data, at: int, end: int, time: int, scale: int, key: bool | None) -> None:
    track, relative, flags, frames = block(data, at, end)
    step = media.tracks.get(track, {}).get("default_duration", 0)
    for i, (offset, size) in enumerate(frames):
        media.packets.append(Packet(track, time + relative + i * step // scale, bool(flags & 0x80) if key is None else key, len(media.clusters), offset, size))


def features(media: Media, payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8)
    clusters = set(media.clusters)
    indexed = sum((at, time) in clusters for time, _, at in media.cues)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={indexed};last_ms={media.packets[-1].timestamp};ms={media.duration:.3f};sum={int(samples.sum(dtype=np.int64))};steps={int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))}"


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each text as a Matroska file, reads the file back and describes both."""
    c.small_batches(docs.sparkSession)

    def row(raw: bytes) -> tuple:
        stored = mux(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
        media = parse(stored)
        back = b"".join(stored[p.offset : p.offset + p.size] for p in media.packets)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, back)

    def run(batches):
        for batch in batches:
            rows = [row((text or "").encode()) for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


PACKETS = "id long, packet long, track long, timestamp_ns long, keyframe boolean, cluster long, byte_offset long, byte_size long, error string"


def packets(files: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """The packet table of a column of Matroska files; a null file has no packets, a damaged one besides a row with the error."""
    c.small_batches(files.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                error, found = None, []
                try:
                    scale = parse(data, found).scale
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    scale, error = 1_000_000, str(e) or type(e).__name__
                rows += [(key, i, p.track, p.timestamp * scale, p.keyframe, p.cluster, p.offset, p.size, None) for i, p in enumerate(found)]
                if error:
                    rows.append((key, None, None, None, None, None, None, None, error))
            kinds = (*[pa.int64()] * 4, pa.bool_(), *[pa.int64()] * 3, pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PACKETS.split(", ")])

    return files.select(files[id_column].cast("long"), media_column).mapInArrow(run, PACKETS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(c.documents(spark, sf_dir))
