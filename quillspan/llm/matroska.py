"""Media columns: Matroska files in a binary column, as tables of packets, tracks and cues.

`demux` walks the EBML elements of each file: variable-length identifiers and sizes,
elements of unknown size, blocks alone and in groups, the three ways to lace frames, and
cues. It returns arrays of byte ranges, not the bytes, so a packet costs a few numbers;
`packet_table` and `cue_table` are those arrays as rows, and a packet's bytes are
`substring(media, offset + 1, length)`. `store` writes text payloads losslessly as 8-bit
PCM samples (8 kHz, one channel) in such files. Both are one pass over the rows: no
shuffle, no state, and memory for one batch of bounded bytes and one file.

Defined results. A null media value: null arrays and a `problem`. A file that isn't
Matroska, is cut short or contradicts itself never fails the job: what was read before the
fault is returned, and `problem` names the fault (null if there is none). Unknown elements
are skipped. A frame's time is its block's plus the durations of the frames laced
before it, where these are known: from the block's duration, PCM's own rate or the
track's default; else its duration is null and its time the block's. Only the first
segment is read. A null or empty text gives one frame of padding. Rows that repeat are
stored each. An empty table gives no rows. Columns that are carried along are named by
the caller; others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import byte_texts, keyed, lean, materialize, wide

# Element identifiers of the format
EBML, DOC_TYPE, SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x1A45DFA3, 0x4282, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TAGS, CHAPTERS, ATTACHMENTS = 0x1254C367, 0x1043A770, 0x1941A469
# of elements that hold others: the parent in which they are entered
PARENT = {SEGMENT: 0, INFO: SEGMENT, TRACKS: SEGMENT, TRACK_ENTRY: TRACKS, AUDIO: TRACK_ENTRY, CLUSTER: SEGMENT, BLOCK_GROUP: CLUSTER, CUES: SEGMENT, CUE_POINT: CUES, CUE_POSITIONS: CUE_POINT}
TOP = {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}  # these end a cluster of unknown size
LACING = {0: "none", 2: "xiph", 4: "fixed", 6: "ebml"}

PACKET = "struct<track:long,time_ns:long,duration_ns:long,keyframe:boolean,lacing:string,frame:int,block_ns:long,cluster_at:long,block_at:long,offset:long,length:long>"
TRACK = "struct<track:long,type:long,codec:string,rate:double,channels:long,bits:long,default_ns:long>"
CUE = "struct<track:long,time_ns:long,cluster_at:long,block_at:long>"

UNIT, FRAMES, BLOCKS = 576, 8, 10  # bytes of a payload's unit; units of a block; blocks of a cluster
RATE = 8000
#: How a block's bytes are cut into frames, by the lacing that its number gives.
CUTS = (("fixed", (UNIT,)), ("xiph", (UNIT // 2, UNIT * 3 // 2)), ("ebml", (UNIT * 3 // 4, UNIT * 5 // 4)))


class Fault(ValueError):
    """The file contradicts the format."""


def read_number(data: bytes, at: int, most: int = 8) -> tuple[int, int]:
    """A variable-length number with its marker bit, and its width in bytes."""
    if at >= len(data):
        raise Fault("cut short")
    width = 9 - data[at].bit_length()
    if width > most:
        raise Fault("a number is too wide")
    if at + width > len(data):
        raise Fault("cut short")
    return int.from_bytes(data[at : at + width], "big"), width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length size without its marker, None if unknown, and the place after it."""
    value, width = read_number(data, at)
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, end) of the frames of a block whose header ends at `at`."""
    if not lacing:
        return [(at, end)]
    if at >= end:
        raise Fault("a block without frames")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 4:
        if (end - at) % count:
            raise Fault("fixed lacing doesn't divide the block")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == 2:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise Fault("lacing runs out of its block")
                size, last, at = size + data[at], data[at], at + 1
                if last < 255:
                    break
            sizes.append(size)
    else:
        for k in range(count - 1):
            value, width = read_number(data, at)
            value, at = value & ((1 << 7 * width) - 1), at + width
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise Fault("lacing runs out of its block")
        out.append((at, at + size))
        at += size
    if at > end:
        raise Fault("lacing runs out of its block")
    return [*out, (at, end)]


def elements(data: bytes, problems: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(parent, identifier, start, body, end) of the elements in their order, those inside others after these."""
    if read_number(data, 0, 4)[0] != EBML:
        raise Fault("no EBML header")
    at, inside = 0, [(0, len(data), False)]  # identifier, end, whether that is a guess
    while at < len(data):
        while len(inside) > 1 and at >= inside[-1][1]:
            inside.pop()
        number, width = read_number(data, at, 4)
        size, body = read_size(data, at + width)
        while len(inside) > 1 and inside[-1][2] and number in TOP and PARENT.get(number, SEGMENT) != inside[-1][0]:
            inside.pop()
        parent, limit, _ = inside[-1]
        if size is None and number not in (SEGMENT, CLUSTER):
            raise Fault("an element of unknown size")
        end = limit if size is None else body + size
        if end > limit:
            problems.append("an element reaches beyond its parent")
            end = limit
        yield parent, number, at, body, end
        enter = PARENT.get(number) == parent
        if enter:
            inside.append((number, end, size is None))
        at = body if enter else end


@dataclass
class Parsed:
    """What a file holds; times in ticks of `scale` nanoseconds."""

    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    clusters: list[list[int]] = field(default_factory=list)  # start, body, ticks
    blocks: list[tuple] = field(default_factory=list)  # cluster, start, track, ticks, keyframe or None, lacing, frames, group
    cues: list[dict] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


def _unsigned(data: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise Fault("an integer of more than 8 bytes")
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    if end - at not in (0, 4, 8):
        raise Fault("a float of another size")
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end > at else 0.0


def _block(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, ticks, flags and frames of a block's body."""
    track, at = read_size(data, at)
    if track is None or at + 3 > end:
        raise Fault("a block without a header")
    flags = data[at + 2]
    return track, int.from_bytes(data[at : at + 2], "big", signed=True), flags, laced(data, at + 3, end, flags & 6)


#: Values of a track or cue: where they stand, their name and how they are read.
_TRACK = {(TRACK_ENTRY, TRACK_NUMBER): "track", (TRACK_ENTRY, TRACK_TYPE): "type", (TRACK_ENTRY, DEFAULT_DURATION): "default_ns", (AUDIO, CHANNELS): "channels", (AUDIO, BIT_DEPTH): "bits"}
_CUE = {(CUE_POSITIONS, CUE_TRACK): "track", (CUE_POSITIONS, CUE_CLUSTER): "cluster_at", (CUE_POSITIONS, CUE_RELATIVE): "block_at"}


def parse(data: bytes) -> Parsed:
    """The first segment of a file, up to the first fault."""
    out, segment, point, group = Parsed(), None, {}, {}
    try:
        for parent, number, start, body, end in elements(data, out.problems):
            here = (parent, number)
            if number == SEGMENT:
                if segment is not None:
                    break
                segment = body
            elif number == EBML and b"matroska" not in data[body:end] and b"webm" not in data[body:end]:
                raise Fault("another kind of EBML file")
            elif here == (SEGMENT, CLUSTER):
                out.clusters.append([start - segment, body, 0])
            elif here == (CLUSTER, TIMESTAMP):
                out.clusters[-1][2] = _unsigned(data, body, end)
            elif here == (CLUSTER, BLOCK_GROUP):
                group = {"start": start, "reference": False}
            elif here == (BLOCK_GROUP, BLOCK_DURATION):
                group["duration"] = _unsigned(data, body, end)
            elif here == (BLOCK_GROUP, REFERENCE_BLOCK):
                group["reference"] = True
            elif here in ((CLUSTER, SIMPLE_BLOCK), (BLOCK_GROUP, BLOCK)):
                own = group if number == BLOCK else {}
                track, ticks, flags, frames = _block(data, body, end)
                out.blocks.append((len(out.clusters) - 1, own.get("start", start), track, ticks, None if number == BLOCK else bool(flags & 128), flags & 6, frames, own))
            elif here == (TRACKS, TRACK_ENTRY):
                out.tracks.append({"channels": 1, "rate": 8000.0})
            elif here in _TRACK:
                out.tracks[-1][_TRACK[here]] = _unsigned(data, body, end)
            elif here == (TRACK_ENTRY, CODEC_ID):
                out.tracks[-1]["codec"] = data[body:end].rstrip(b"\0").decode("ascii", "replace")
            elif here == (AUDIO, SAMPLING_FREQUENCY):
                out.tracks[-1]["rate"] = _float(data, body, end)
            elif here == (INFO, TIMESTAMP_SCALE):
                out.scale = _unsigned(data, body, end)
            elif here == (CUES, CUE_POINT):
                point = {"time": 0}
            elif here == (CUE_POINT, CUE_TIME):
                point["time"] = _unsigned(data, body, end)
            elif here == (CUE_POINT, CUE_POSITIONS):
                out.cues.append({"point": point})
            elif here in _CUE:
                out.cues[-1][_CUE[here]] = _unsigned(data, body, end)
    except Fault as fault:
        out.problems.append(str(fault))
    return out


_LONG = (1 << 63) - 1


def _long(value: int | None) -> int | None:
    return None if value is None else max(-_LONG, min(_LONG, value))


def packets(found: Parsed) -> Iterator[tuple]:
    """The frames of a file as PACKET rows."""
    per_byte, default = {}, {}
    for t in found.tracks:
        width = t["channels"] * t.get("bits", 0) * t["rate"]
        if t.get("codec", "").startswith("A_PCM") and 1 <= width < math.inf:
            per_byte[t.get("track")] = 8e9 / width
        default[t.get("track")] = t.get("default_ns")
    for cluster, start, track, ticks, key, lacing, frames, group in found.blocks:
        at, body, base = found.clusters[cluster]
        begin = time = (base + ticks) * found.scale
        keyframe = not group["reference"] if key is None else key
        whole = group.get("duration")
        for k, (first, last) in enumerate(frames):
            if whole is not None:
                length = whole * found.scale // len(frames)
            elif track in per_byte:
                length = round((last - first) * per_byte[track])
            else:
                length = default.get(track)
            yield track, _long(time), _long(length), keyframe, LACING[lacing], k, _long(begin), at, start - body, first, last - first
            time += length or 0


def _structs(rows: list[tuple], counts: list[int | None], names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    """A list column of structs: counts[i] of the rows belong to file i, None is a null list."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    ends = np.cumsum([0, *[n or 0 for n in counts]])
    offsets = pa.array([None if n is None else int(e) for n, e in zip([*counts, 0], ends, strict=True)], pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


_I, _N, _T = pa.int64(), pa.int32(), pa.string()
_PACKETS = (["track", "time_ns", "duration_ns", "keyframe", "lacing", "frame", "block_ns", "cluster_at", "block_at", "offset", "length"], [_I, _I, _I, pa.bool_(), _T, _N, _I, _I, _I, _I, _I])
_TRACKS = (["track", "type", "codec", "rate", "channels", "bits", "default_ns"], [_I, _I, _T, pa.float64(), _I, _I, _I])
_CUES = (["track", "time_ns", "cluster_at", "block_at"], [_I, _I, _I, _I])
PARSED = f"tracks array<{TRACK}>, packets array<{PACKET}>, cues array<{CUE}>, problem string"
PAYLOAD = "payload_bytes long, n_bytes long, payload_sha256 string, tail_crc32 long, level long, loudness long, crossings long"


def _facts(data: bytes, rows: list[tuple]) -> tuple:
    """Of the samples that the packets hold, in the order of their times: PAYLOAD."""
    if any(a[1] > b[1] for a, b in zip(rows, rows[1:], strict=False)):
        rows = sorted(rows, key=lambda r: r[1])
    payload = b"".join([data[r[9] : r[9] + r[10]] for r in rows])
    x = np.frombuffer(payload, np.uint8)
    squares = int(np.bincount(x, minlength=256) @ (np.arange(256) - 128) ** 2)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    n = max(len(x), 1)
    return len(payload), len(payload.rstrip(b"\xff")), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), 100 * int(x.sum(dtype=np.int64)) // n, math.isqrt(10_000 * squares // n), crossings


def demux(files: DataFrame, media: str = "media", keep: tuple[str, ...] = (), payload: bool = False) -> DataFrame:
    """The columns `keep`, and PARSED of the column `media`; with `payload` also PAYLOAD, of all packets' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield _parsed(part, keep, payload)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keyed(files, *keep).schema)
    return keyed(files, *keep, media).mapInArrow(lean(run), kept + PARSED + f", {PAYLOAD}" * payload)


def _parsed(part: pa.RecordBatch, keep: tuple[str, ...], payload: bool) -> pa.RecordBatch:
    rows: dict[str, list] = {"t": [], "p": [], "c": []}
    counts: dict[str, list] = {"t": [], "p": [], "c": []}
    problems, facts = [], []
    for value in part.column(part.num_columns - 1).to_pylist():
        if value is None:
            for k in counts:
                counts[k].append(None)
            problems.append("no file"), facts.append((None,) * 7)
            continue
        found = parse(value)
        own = {
            "t": [(_long(t.get("track")), _long(t.get("type")), t.get("codec"), t["rate"], _long(t["channels"]), _long(t.get("bits")), _long(t.get("default_ns"))) for t in found.tracks],
            "p": list(packets(found)),
            "c": [(_long(c.get("track")), _long(c["point"]["time"] * found.scale), _long(c.get("cluster_at")), _long(c.get("block_at"))) for c in found.cues],
        }
        for k, new in own.items():
            rows[k] += new
            counts[k].append(len(new))
        problems.append("; ".join(dict.fromkeys(found.problems)) or None)
        if payload:
            facts.append(_facts(value, own["p"]))
    columns = [part.column(k) for k in range(len(keep))]
    columns += [_structs(rows["t"], counts["t"], *_TRACKS), _structs(rows["p"], counts["p"], *_PACKETS), _structs(rows["c"], counts["c"], *_CUES), pa.array(problems, _T)]
    names = [*keep, "tracks", "packets", "cues", "problem"]
    if payload:
        kinds = [_I, _I, _T, _I, _I, _I, _I]
        columns += [pa.array(c, k) for c, k in zip(zip(*facts, strict=True), kinds, strict=True)]
        names += ["payload_bytes", "n_bytes", "payload_sha256", "tail_crc32", "level", "loudness", "crossings"]
    return pa.RecordBatch.from_arrays(columns, names)


def packet_table(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row for each packet: the columns `keep`, and PACKET's."""
    return parsed.select(*keep, F.inline("packets"))


def cue_table(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row for each cue: the columns `keep`, CUE's, and `found`, whether a block of the track
    begins at the place and time that the cue names."""
    return parsed.select(*keep, F.inline(_checked_cues()))


def _place(x: Column, time: str) -> Column:
    return F.concat_ws(":", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in ("track", time, "cluster_at", "block_at")])


def _checked_cues() -> Column:
    blocks = F.map_from_arrays(_blocks(), F.transform(_blocks(), lambda _: F.lit(True)))
    return F.transform("cues", lambda c: F.struct(c["track"].alias("track"), c["time_ns"].alias("time_ns"), c["cluster_at"].alias("cluster_at"), c["block_at"].alias("block_at"), F.coalesce(F.try_element_at(blocks, _place(c, "time_ns")), F.lit(False)).alias("found")))


def _blocks() -> Column:
    return F.array_distinct(F.transform(F.filter("packets", lambda p: p["frame"] == 0), lambda p: _place(p, "block_ns")))


# --- writing


def _number(value: int, width: int) -> bytes:
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes, width: int = 0) -> bytes:
    """An element; its size takes `width` bytes, or as few as hold it."""
    if not width:
        width = 1
        while len(body) >= (1 << 7 * width) - 1:
            width += 1
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + _number(len(body), width) + body


def unsigned(number: int, value: int, width: int = 0) -> bytes:
    return element(number, value.to_bytes(width or max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """Frames in a block's body, after its header."""
    if kind == "none":
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml" and len(sizes) > 1:
        width = 1
        while sizes[0] >= (1 << 7 * width) - 1:
            width += 1
        head += _number(sizes[0], width)
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while abs(n - before) >= 1 << 7 * width - 1:
                width += 1
            head += _number(n - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, ticks: int, frames: list[bytes], kind: str, keyframe: bool = True) -> bytes:
    """The body of a block."""
    flags = (128 if keyframe else 0) | next(k for k, v in LACING.items() if v == kind)
    return _number(track, 1) + ticks.to_bytes(2, "big", signed=True) + bytes([flags]) + lace(frames, kind)


def _frames(body: bytes, sizes: Iterable[int]) -> list[bytes]:
    out, at, k, sizes = [], 0, 0, tuple(sizes)
    while at < len(body):
        n = sizes[k % len(sizes)]
        out.append(body[at : at + n])
        at, k = at + n, k + 1
    return out


_HEADER = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(DOC_TYPE, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
_AUDIO = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
    + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))))


def padded(text: bytes | None) -> bytes:
    """The payload of a text: bytes 255, which UTF-8 never has, up to a positive multiple of UNIT."""
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\xff")


def mux(payload: bytes) -> bytes:
    """A file of 8-bit samples: clusters of laced blocks, with a cue for each cluster."""
    per = RATE // 1000  # bytes of a tick
    head = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / per)) + element(MUXING_APP, b"quillspan") + element(WRITING_APP, b"quillspan")) + _AUDIO
    seek = lambda at: element(SEEK_HEAD, element(SEEK, element(SEEK_ID, CUES.to_bytes(4, "big")) + unsigned(SEEK_POSITION, at, 8)))
    at = len(seek(0)) + len(head)
    parts, cues = [], []
    size = UNIT * FRAMES
    for c, begin in enumerate(range(0, len(payload), size * BLOCKS)):
        time = unsigned(TIMESTAMP, begin // per)
        blocks = []
        for b, first in enumerate(range(begin, min(begin + size * BLOCKS, len(payload)), size)):
            kind, cuts = CUTS[(c + b) % len(CUTS)]
            frames = _frames(payload[first : min(first + size, begin + size * BLOCKS)], cuts)
            blocks.append(element(SIMPLE_BLOCK, block(1, (first - begin) // per, frames, kind if len(frames) > 1 else "none")))
        cluster = element(CLUSTER, time + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, begin // per) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at) + unsigned(CUE_RELATIVE, len(time)))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, seek(at) + head + b"".join(parts) + element(CUES, b"".join(cues)), 8)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media, the file that holds the text's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(padded(t)) for t in byte_texts(part.column(1))], pa.binary())], ["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wide(keyed(docs, "doc_id", "text")).mapInArrow(lean(run), f"doc_id {kind}, media binary")


def feature(parsed: DataFrame) -> DataFrame:
    """parsed with `feature`: what the file's tables and samples say, for files with payload facts."""
    count = lambda kind: F.size(F.filter("packets", lambda p: p["lacing"] == kind)).cast("string")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    first = F.try_element_at("tracks", F.lit(1))
    length = F.aggregate("packets", F.lit(0.0), lambda a, p: a + F.coalesce(p["duration_ns"].cast("double"), F.lit(0.0)))
    out = parsed.withColumn("_cues", _checked_cues())
    parts = [
        ("codec=", text(first["codec"])), ("rate=", text(first["rate"].try_cast("long"))), ("bits=", text(first["bits"])), ("ms=", text((length / 1_000_000).try_cast("long"))),
        ("clusters=", text(F.size(F.array_distinct(F.transform("packets", lambda p: p["cluster_at"]))))), ("packets=", text(F.size("packets"))),
        ("lacing=", F.concat_ws("/", *[count(k) for k in LACING.values()])), ("cues=", F.concat_ws("/", F.size(F.filter("_cues", lambda c: c["found"])).cast("string"), F.size("_cues").cast("string"))),
        ("level=", text(F.col("level"))), ("loudness=", text(F.col("loudness"))), ("crossings=", text(F.col("crossings"))), ("problem=", text(F.col("problem"))),
    ]
    return out.withColumn("feature", F.concat_ws(" ", *[F.concat(F.lit(k), v) for k, v in parts])).drop("_cues")


def stored_texts(docs: DataFrame) -> DataFrame:
    """Texts written as media files and read back from the stored table: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    files = materialize(store(docs), "media", compression="zstd")
    files = files.select("doc_id", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    out = feature(demux(files, "media", ("doc_id", "media_bytes", "media_sha256"), payload=True))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
