"""Media columns: Matroska files parsed into packet tables.

A file is a tree of EBML elements: an identifier and a size, both of variable length, then data. The
parser walks one file's bytes without copying data: tracks and cues give names and seek points; clusters give
a base time; SimpleBlocks and BlockGroups give track, relative time and flags, and are split into
packets by their lacing (none, Xiph, fixed or EBML), each with the byte range of its data in the file.
Elements of unknown size end where an element of an upper level begins; a file that ends early gives
the packets of the SimpleBlocks and BlockGroups that are there whole.

Packets with laced times: the block's time, plus the track's default duration for each frame
before it in the lace (none where the track has no default duration). A packet is a cue if a cue point
names its track and its block's cluster and time.

`mux` writes such files, so that text tables can be turned into media columns and back: every line is a packet.

Defined cases: null, empty, foreign or damaged bytes give no packets, or those before the damage; a null identifier is
carried; repeated rows give their packets again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import rows
from . import textnp as T

EBML, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK, NUMBER, KIND, CODEC, DEFAULT = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
CUES, POINT, CUE_TIME, CUE_TRACK, CUE_NUMBER, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
TOP = {SEGMENT, EBML}
#: Elements that end a cluster, or another child of the segment, of unknown size.
LEVEL1 = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469} | TOP
LACING = ("none", "xiph", "fixed", "ebml")
SCHEMA = "track bigint, codec string, packet int, timestamp_ns bigint, duration_ns bigint, keyframe boolean, lacing string, cue boolean, begin bigint, end bigint"


class Damage(ValueError):
    """Bytes that are no element."""


class Packet(NamedTuple):
    track: int
    codec: str | None
    packet: int
    timestamp_ns: int
    duration_ns: int | None
    keyframe: bool
    lacing: str
    cue: bool
    begin: int
    end: int


def number(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length number (with its length mark if keep) and where it ends; -1 for an unknown size."""
    if at >= end or not data[at]:
        raise Damage
    first = data[at]
    size = 9 - first.bit_length()
    if at + size > end:
        raise Damage
    value = int.from_bytes(data[at : at + size], "big")
    if keep:
        return value, at + size
    value &= (1 << 7 * size) - 1
    return (-1 if value == (1 << 7 * size) - 1 else value), at + size


#: Elements of which the part that is there is read, where a file ends early.
CONTAINERS = TOP | {INFO, TRACKS, TRACK, CUES, POINT, CUE_TRACK, CLUSTER}


def children(data: bytes, at: int, end: int, parents: set[int] = TOP) -> Iterator[tuple[int, int, int]]:
    """The elements (identifier, begin and end of data) from `at`; those of unknown size end at an element of `parents`. One that is cut off is damage, unless a container."""
    while at < end:
        name, at = number(data, at, end, keep=True)
        size, at = number(data, at, end)
        stop = at + size if size >= 0 else _extent(data, at, end, LEVEL1 if name not in TOP else TOP)
        if stop > end and name not in CONTAINERS:
            raise Damage
        yield name, at, min(stop, end)
        at = stop


def _extent(data: bytes, at: int, end: int, enders: set[int]) -> int:
    while at < end:
        try:
            name, after = number(data, at, end, keep=True)
            if name in enders:
                return at
            size, after = number(data, after, end)
        except Damage:
            return end
        at = after + size if size >= 0 else after
    return end


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; `at` is behind the block's flags."""
    if kind == 0:
        return [(at, end)]
    if at >= end:
        raise Damage
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damage
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif kind == 3 and count > 1:
        size, at = number(data, at, end)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            step, at = number(data, at, end)
            width = at - before
            step = (1 << 7 * width) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - ((1 << (7 * width - 1)) - 1))
    if kind == 2:
        if (end - at) % count:
            raise Damage
        sizes = [(end - at) // count] * count
    else:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damage
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def packets(data: bytes | None) -> list[Packet]:
    """All packets of a file in the order of its bytes."""
    out: list[Packet] = []
    if not data:
        return out
    found: list[tuple[int, int, int, int, int | None, bool, int, int, int]] = []
    scale, codecs, defaults, cues, segment = 1_000_000, {}, {}, set(), 0
    end = len(data)

    def block(cluster: int, base: int, a: int, b: int, simple: bool, duration: int | None, key: bool) -> None:
        track, at = number(data, a, b)
        if at + 3 > b:
            raise Damage
        relative = struct.unpack(">h", data[at : at + 2])[0]
        flags = data[at + 2]
        kind = flags >> 1 & 3
        key = bool(flags & 128) if simple else key
        frames = laces(data, at + 3, b, kind)
        for n, (x, y) in enumerate(frames):
            found.append((track, cluster, base + relative, n, duration if len(frames) == 1 else None, key, kind, x, y))

    try:
        for top, a, b in children(data, 0, end):
            if top != SEGMENT:
                continue
            segment = a
            for name, x, y in children(data, a, b, LEVEL1):
                if name == INFO:
                    for n, p, q in children(data, x, y):
                        scale = unsigned(data, p, q) if n == SCALE else scale
                elif name == TRACKS:
                    for n, p, q in children(data, x, y):
                        if n == TRACK:
                            got = {m: (r, s) for m, r, s in children(data, p, q)}
                            me = unsigned(data, *got[NUMBER]) if NUMBER in got else 0
                            codecs[me] = data[slice(*got[CODEC])].decode("ascii", "replace") if CODEC in got else None
                            defaults[me] = unsigned(data, *got[DEFAULT]) if DEFAULT in got else 0
                elif name == CUES:
                    for n, p, q in children(data, x, y):
                        if n == POINT:
                            time, places = 0, []
                            for m, r, s in children(data, p, q):
                                if m == CUE_TIME:
                                    time = unsigned(data, r, s)
                                elif m == CUE_TRACK:
                                    got = {k: unsigned(data, u, v) for k, u, v in children(data, r, s)}
                                    places.append((got.get(CUE_NUMBER, 0), got.get(CUE_CLUSTER, 0)))
                            cues |= {(track, place, time) for track, place in places}
                elif name == CLUSTER:
                    base, here = 0, _head(data, x, segment)
                    for n, p, q in children(data, x, y):
                        if n == TIME:
                            base = unsigned(data, p, q)
                        elif n == SIMPLE:
                            if q - p < 4:
                                raise Damage
                            block(here, base, p, q, True, None, False)
                        elif n == GROUP:
                            got = {m: (r, s) for m, r, s in children(data, p, q)}
                            if BLOCK in got:
                                block(here, base, *got[BLOCK], False, unsigned(data, *got[DURATION]) if DURATION in got else None, REFERENCE not in got)
    except (Damage, struct.error, IndexError):
        pass
    for k, (track, cluster, time, n, duration, key, kind, x, y) in enumerate(found):
        step = defaults.get(track, 0)
        length = duration * scale if duration is not None else step or None
        out.append(Packet(track, codecs.get(track), k, time * scale + n * step, length, key, LACING[kind], (track, cluster, time) in cues, x, y))
    return out


def _head(data: bytes, at: int, segment: int) -> int:
    """Where the cluster whose data begin at `at` begins, from the segment's data: its identifier has 4 bytes, its size up to 8."""
    mark = CLUSTER.to_bytes(4, "big")
    return data.rfind(mark, max(segment, at - 12), at) - segment


def size_of(value: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_of(len(data)) + data


def whole(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def laced(frames: list[bytes], kind: int) -> bytes:
    """The lacing header and the frames of a block."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += size_of(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if -(1 << (7 * w - 1)) + 1 < b - a < (1 << (7 * w - 1)) - 1)
            head += size_of(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def mux(frames: Iterable[tuple[int, int, bytes]], codec: str = "S_TEXT/UTF8", step_ms: int = 40, per_cluster: int = 32, lace: int = 4) -> bytes:
    """A file of frames (track, time in ms, data). Runs of up to `lace` frames of a track share a block, lacings in turn."""
    frames = list(frames)
    tracks = sorted({t for t, _, _ in frames})
    head = element(EBML, element(0x4282, b"matroska"))
    body = element(INFO, element(SCALE, whole(1_000_000)))
    body += element(TRACKS, b"".join(element(TRACK, element(NUMBER, whole(t)) + element(KIND, whole(17)) + element(CODEC, codec.encode()) + element(DEFAULT, whole(step_ms * 1_000_000))) for t in tracks))
    points, turn = [], 0
    for c in range(0, len(frames), per_cluster):
        part = frames[c : c + per_cluster]
        base = part[0][1]
        inner = element(TIME, whole(base))
        points.append(element(POINT, element(CUE_TIME, whole(base)) + element(CUE_TRACK, element(CUE_NUMBER, whole(part[0][0])) + element(CUE_CLUSTER, whole(len(body))))))
        at = 0
        while at < len(part):
            run = [part[at]]
            while len(run) < lace and at + len(run) < len(part) and part[at + len(run)][0] == run[0][0] and part[at + len(run)][1] == run[0][1] + step_ms * len(run):
                run.append(part[at + len(run)])
            data = [f for _, _, f in run]
            kind = 0 if len(run) == 1 else (1, 3, 2)[turn % 3]
            if kind == 2 and len({len(f) for f in data}) > 1:
                kind = 3
            lead = size_of(run[0][0]) + struct.pack(">h", run[0][1] - base)
            if turn % 4 == 3 and len(run) == 1:
                inner += element(GROUP, element(BLOCK, lead + bytes([kind << 1]) + laced(data, kind)) + element(DURATION, whole(step_ms)))
            else:
                inner += element(SIMPLE, lead + bytes([128 | kind << 1]) + laced(data, kind))
            turn += 1
            at += len(run)
        body += element(CLUSTER, inner)
    return head + element(SEGMENT, body + element(CUES, b"".join(points)))


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines = batch.column(0), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([ids, pa.array([None if x is None else mux((t["track"], 40 * k, t["text"].encode()) for k, t in enumerate(x)) for x in lines], pa.binary())], batch.schema.names[:1] + ["media"])


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for batch in (part for whole_ in batches for part in T.slices(whole_, 1)):
        found, owner = [], []
        for k, data in enumerate(batch.column(1).to_pylist()):
            got = packets(data)
            found += got
            owner += [k] * len(got)
        schema = schema or pa.schema([batch.schema.field(0), *[pa.field(n, t) for n, t in zip(Packet._fields, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))]])
        columns = list(zip(*found)) if found else [[] for _ in Packet._fields]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)


def packet_table(media: DataFrame, ident: str, column: str = "media") -> DataFrame:
    """A row (identifier, track, codec, packet, timestamp_ns, duration_ns, keyframe, lacing, cue, begin, end) for every packet."""
    schema = ST.StructType([media.schema[ident], *ST._parse_datatype_string(SCHEMA).fields])
    return media.select(ident, column).mapInArrow(T.lean(_packets), schema)


def text_media(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (identifier, media): each text as a file, its lines as packets of 40 ms; lines that don't begin with a capital letter go to track 2."""
    rows.bound_batches(docs.sparkSession)
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.when(x.rlike(r"^\p{Lu}"), 1).otherwise(2).alias("track"), x.alias("text")))
    schema = ST.StructType([docs.schema[ident], ST.StructField("media", ST.BinaryType())])
    return docs.select(ident, lines.alias("lines")).mapInArrow(T.lean(_mux), schema)
