"""Matroska: a parser of EBML elements into packet tables, and a small audio muxer.

``parse`` walks variable-length elements of known or unknown size, clusters with simple
blocks and block groups, all four kinds of lacing, and cues.  ``mux`` stores 8-bit PCM
samples losslessly in blocks of laced frames, clusters of at most a second, and cues.

Defined results of ``packets``: a null or empty blob, or one that cannot be parsed, gives
one row with ``error`` and null packet columns; repeated rows are parsed each; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
CHAPTERS, TAGS, ATTACHMENTS = 0x1043A770, 0x1254C367, 0x1941A469
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
FRAME = 192
RATE = 19_200
FRAMES_PER_BLOCK = 8
FRAMES_PER_CLUSTER = 96


@dataclass
class Packet:
    track: int
    timestamp: int  # in ticks of the segment's scale
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int


@dataclass
class Media:
    """What a file holds: packets in stored order, tracks by number, cues as (time, track, place)."""

    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # places relative to the segment's data


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer; None for the reserved 'unknown' value."""
    first = data[at]
    if not first:
        raise ValueError("an integer is longer than 8 bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError("the data end inside an integer")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a laced block, and where the first one starts."""
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:  # fixed
        if (end - at) % n:
            raise ValueError("a fixed lace does not divide")
        return [(end - at) // n] * n, at
    if lacing == 1:  # Xiph
        for _ in range(n - 1):
            size = 0
            while True:
                b = data[at]
                at += 1
                size += b
                if b < 255:
                    break
            sizes.append(size)
    else:  # EBML: the first size, then signed differences
        size, at = vint(data, at)
        sizes = [size or 0] if n > 1 else []
        for _ in range(n - 2):
            start = at
            raw, at = vint(data, at)
            width = at - start
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, at


_LACING = ("none", "xiph", "fixed", "ebml")


def _block(data: bytes, a: int, b: int, media: Media, cluster_time: int, cluster: int, keyframe: bool | None) -> None:
    track, at = vint(data, a)
    time = cluster_time + struct.unpack_from(">h", data, at)[0]
    flags = data[at + 2]
    at += 3
    kind = flags >> 1 & 3
    sizes = [b - at]
    if kind:
        sizes, at = lace_sizes(data, at, b, kind)
    key = bool(flags & 128) if keyframe is None else keyframe
    step = int(media.tracks.get(track or 0, {}).get("default_duration", 0)) // media.scale
    for k, size in enumerate(sizes):
        media.packets.append(Packet(track or 0, time + k * step, at, size, key, _LACING[kind], cluster))
        at += size


def _cluster(data: bytes, a: int, b: int | None, media: Media, limit: int) -> int:
    """Reads a cluster; one of unknown size ends at the next top-level element."""
    time, number, at = 0, len(media.clusters) - 1, a
    end = limit if b is None else b
    while at < end:
        ident, content = vint(data, at, keep_marker=True)
        if b is None and ident in TOP:
            return at
        size, content = vint(data, content)
        if size is None or content + size > end:
            raise ValueError("an element of a cluster is too long")
        stop = content + size
        if ident == 0xE7:
            time = _uint(data, content, stop)
        elif ident == 0xA3:
            _block(data, content, stop, media, time, number, None)
        elif ident == 0xA0:
            inner = list(_plain(data, content, stop))
            key = not any(i == 0xFB for i, _, _ in inner)
            for i, x, y in inner:
                if i == 0xA1:
                    _block(data, x, y, media, time, number, key)
        at = stop
    return end


def _plain(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        ident, at = vint(data, at, keep_marker=True)
        size, at = vint(data, at)
        if size is None or at + size > end:
            raise ValueError("an element is longer than what holds it")
        yield ident, at, at + size
        at += size


def parse(data: bytes) -> Media:
    media = Media()
    ident, at = vint(data, 0, keep_marker=True)
    if ident != EBML:
        raise ValueError("not an EBML file")
    size, at = vint(data, at)
    if size is None:
        raise ValueError("the header's size is unknown")
    at += size
    ident, at = vint(data, at, keep_marker=True)
    if ident != SEGMENT:
        raise ValueError("no segment follows the header")
    size, base = vint(data, at)
    end = len(data) if size is None else base + size
    if end > len(data):
        raise ValueError("the data end inside the segment")
    at = base
    while at < end:
        start = at
        ident, at = vint(data, at, keep_marker=True)
        size, at = vint(data, at)
        stop = None if size is None else at + size
        if stop is not None and stop > end:
            raise ValueError("an element is longer than the segment")
        if ident == CLUSTER:
            media.clusters.append(start - base)
            at = _cluster(data, at, stop, media, end)
            continue
        if stop is None:
            raise ValueError("only segments and clusters may have an unknown size")
        if ident == INFO:
            for i, a, b in _plain(data, at, stop):
                if i == 0x2AD7B1:
                    media.scale = _uint(data, a, b)
                elif i == 0x4489:
                    media.duration = _float(data, a, b)
            if not media.scale:
                raise ValueError("the timestamp scale is 0")
        elif ident == TRACKS:
            for i, a, b in _plain(data, at, stop):
                if i == 0xAE:
                    _track(data, a, b, media)
        elif ident == CUES:
            for i, a, b in _plain(data, at, stop):
                if i == 0xBB:
                    _cue(data, a, b, media)
        at = stop
    return media


def _track(data: bytes, a: int, b: int, media: Media) -> None:
    out: dict[str, object] = {}
    for i, x, y in _plain(data, a, b):
        if i in (0xD7, 0x83, 0x23E383):
            out[{0xD7: "number", 0x83: "type", 0x23E383: "default_duration"}[i]] = _uint(data, x, y)
        elif i == 0x86:
            out["codec"] = data[x:y].decode("ascii", "replace").rstrip("\0")
        elif i == 0xE1:
            for j, u, v in _plain(data, x, y):
                if j == 0xB5:
                    out["rate"] = _float(data, u, v)
                elif j == 0x9F:
                    out["channels"] = _uint(data, u, v)
                elif j == 0x6264:
                    out["bit_depth"] = _uint(data, u, v)
    media.tracks[int(out.get("number", 0))] = out


def _cue(data: bytes, a: int, b: int, media: Media) -> None:
    time, found = 0, []
    for i, x, y in _plain(data, a, b):
        if i == 0xB3:
            time = _uint(data, x, y)
        elif i == 0xB7:
            inner = {j: _uint(data, u, v) for j, u, v in _plain(data, x, y)}
            found.append((inner.get(0xF7, 0), inner.get(0xF1, 0)))
    media.cues += [(time, track, place) for track, place in found]


def _size(n: int) -> bytes:
    for width in range(1, 9):
        if n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
    raise ValueError("too long")


def _element(ident: int, content: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
_TRACK = _element(
    TRACKS,
    _element(0xAE, _number(0xD7, 1) + _number(0x73C5, 1) + _number(0x83, 2) + _number(0x9C, 1) + _number(0x23E383, 1_000_000_000 * FRAME // RATE) + _element(0x86, b"A_PCM/INT/LIT") + _element(0xE1, _element(0xB5, struct.pack(">d", RATE)) + _number(0x9F, 1) + _number(0x6264, 8))),
)
_TICKS = 1000 * FRAME // RATE  # of a millisecond a frame


def _lace(kind: int, n: int) -> bytes:
    """The lace's head for n frames of FRAME bytes."""
    if kind == 1:
        return bytes([n - 1]) + bytes([FRAME]) * (n - 1)
    if kind == 3:
        return bytes([n - 1]) + _size(FRAME) + b"\xbf" * (n - 2)  # differences of 0
    return bytes([n - 1])


def mux(samples: bytes) -> bytes:
    """8-bit samples, a positive multiple of FRAME long, as a Matroska file with one PCM track.
    Blocks use the three kinds of lacing in turn."""
    if not samples or len(samples) % FRAME:
        raise ValueError(f"the samples must be a positive multiple of {FRAME}")
    frames = len(samples) // FRAME
    info = _element(INFO, _number(0x2AD7B1, 1_000_000) + _element(0x4489, struct.pack(">d", frames * _TICKS)) + _element(0x4D80, b"plumbline") + _element(0x5741, b"plumbline"))
    parts, at, points = [info, _TRACK], len(info) + len(_TRACK), []
    turn = 0
    for c in range(0, frames, FRAMES_PER_CLUSTER):
        last = min(frames, c + FRAMES_PER_CLUSTER)
        body = [_number(0xE7, c * _TICKS)]
        for f in range(c, last, FRAMES_PER_BLOCK):
            n = min(last, f + FRAMES_PER_BLOCK) - f
            kind = (2, 1, 3)[turn % 3] if n > 1 else 0
            turn += 1
            head = b"\x81" + struct.pack(">hB", (f - c) * _TICKS, 0x80 | kind << 1) + (_lace(kind, n) if kind else b"")
            body.append(_element(0xA3, head + samples[f * FRAME : (f + n) * FRAME]))
        cluster = _element(CLUSTER, b"".join(body))
        points.append(_element(0xBB, _number(0xB3, c * _TICKS) + _element(0xB7, _number(0xF7, 1) + _number(0xF1, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(points)))


_PACKETS = "track int, timestamp_ns long, offset long, size long, keyframe boolean, lacing string, cluster int, error string"


def packets(media: DataFrame, key: str, content: str) -> DataFrame:
    """The packet table of a column of Matroska files: one row per packet, with ``key``."""
    kind = media.schema[key].dataType.simpleString()
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                data = one.column(1)[0].as_py()
                try:
                    found = parse(data or b"")
                    p = found.packets
                    columns = [
                        [x.track for x in p],
                        [x.timestamp * found.scale for x in p],
                        [x.offset for x in p],
                        [x.size for x in p],
                        [x.keyframe for x in p],
                        [x.lacing for x in p],
                        [x.cluster for x in p],
                        [None] * len(p),
                    ]
                    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                except (ValueError, IndexError, OverflowError, struct.error) as e:  # an Arrow value beyond its type is a ValueError
                    arrays = [*[pa.nulls(1, t) for t in kinds[:-1]], pa.array([str(e) or type(e).__name__])]
                if n := len(arrays[0]):
                    yield pa.RecordBatch.from_arrays([pa.repeat(one.column(0)[0], n), *arrays], ["key", *[x.split()[0] for x in _PACKETS.split(", ")]])

    return media.select(F.col(f"`{key}`").alias("key"), F.col(f"`{content}`").cast("binary").alias("content")).mapInArrow(rows, f"key {kind}, {_PACKETS}").withColumnRenamed("key", key)


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each whole text (null: empty) as UTF-8, padded with blanks to frames, stored as PCM in a
    Matroska file and read back through the packet table.  ``feature``: packets, clusters, cues
    that point at a cluster, milliseconds, mean and variance of the samples.  With ``keep_media``
    the file itself too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                block = batch.slice(at, 400)
                out = []
                for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    own = text or b""
                    file = mux(own + b" " * (-len(own) % FRAME or (FRAME if not own else 0)))
                    found = parse(file)
                    back = b"".join([file[p.offset : p.offset + p.size] for p in found.packets])
                    values = np.frombuffer(back, np.uint8)
                    total, squares = int(values.sum(dtype=np.int64)), int(np.square(values, dtype=np.int64).sum())
                    mean = total / len(back)
                    cued = len({place for _, _, place in found.cues} & set(found.clusters))
                    feature = f"{len(found.packets)},{len(found.clusters)},{cued},{len(found.packets) * _TICKS},{mean:.4f},{squares / len(back) - mean * mean:.4f}"
                    out.append((doc_id, len(own), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature, file if keep_media else None))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                names = [x.split()[0] for x in _STORED.split(", ")]
                if keep_media:
                    arrays, names = [*arrays, pa.array(columns[8], pa.binary())], [*names, "media"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    return slim.mapInArrow(rows, _STORED + (", media binary" if keep_media else ""))
