"""Containers of coded streams, as table functions over BINARY columns.

Each reader is a generator over bytes; ``scan`` runs it over a frame's rows in Arrow batches. A malformed row
gives what was read before the fault and one row with its class and message; it never fails the job.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.functions import bits


class Malformed(ValueError):
    """The data breaks its format."""


class Unsupported(ValueError):
    """The data is well-formed but of a kind that is not read."""


def scan(frame: DataFrame, key: str, data: str, reader: Callable[[bytes], Iterator[tuple]], schema: str, strict: bool = False) -> DataFrame:
    """key, the reader's columns (``schema``), place, error, message: a row for each item of each row's data.

    strict: a fault ends the job instead of giving a row.
    """
    key_type = frame.schema[key].dataType.simpleString()
    fields = T._parse_datatype_string(schema).fields
    out = f"{key} {key_type}, place int, {schema}, error string, message string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, raw in zip(batch.column(0), batch.column(1), strict=True):
                place = 0
                try:
                    for place, item in enumerate(reader(raw.as_py() or b""), 1):
                        keys.append(k.as_py())
                        rows.append((place - 1, *item, None, None))
                except (Malformed, Unsupported, struct.error, IndexError, UnicodeDecodeError) as fault:
                    if strict:
                        raise
                    keys.append(k.as_py())
                    kind = "Unsupported" if isinstance(fault, Unsupported) else "Bitstream"
                    rows.append((place, *[None] * len(fields), kind, str(fault)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) + 3)
            types = [pa.int32(), *[_arrow(f.dataType) for f in fields], pa.string(), pa.string()]
            names = [key, "place", *[f.name for f in fields], "error", "message"]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names)

    return frame.select(key, data).mapInArrow(run, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[kind.simpleString()]


# IVF


def ivf_header(data: bytes) -> tuple[int, bytes, int, int, int, int, int]:
    """Offset of the first frame, codec, width, height, rate, scale, number of frames."""
    if len(data) < 32 or data[:4] != b"DKIF":
        raise Malformed("not an IVF file")
    length, codec, width, height, rate, scale, frames = struct.unpack_from("<H4sHHIII", data, 6)
    return max(length, 32), codec, width, height, rate, scale, frames


def ivf_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Time and data of each frame."""
    at = ivf_header(data)[0]
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<IQ", data, at)
        if pts >= 1 << 63:
            raise Malformed("time beyond 2^63")
        if at + 12 + size > len(data):
            raise Malformed("frame runs past the end of the file")
        yield pts, data[at + 12 : at + 12 + size]
        at += 12 + size


def little_endian(value, octets: int):
    """A number's bytes, lowest first, as a Column."""
    turned = F.reverse(F.sequence(F.lit(0), F.lit(octets - 1)))
    whole = F.lpad(F.hex(value), 2 * octets, "0")
    return F.unhex(F.array_join(F.transform(turned, lambda k: F.substring(whole, k * 2 + 1, F.lit(2))), ""))


def ivf_files(frames: DataFrame, key: str, pts: str, data: str, width: int, height: int, rate: int, scale: int) -> DataFrame:
    """key, file: an IVF file of each key's frames in the order of their times. A file is one value, as in memory."""
    one = F.concat(little_endian(F.length(data), 4), little_endian(F.col(pts), 8), F.col(data))
    body = F.array_sort(F.collect_list(F.struct(F.col(pts).alias("pts"), one.alias("frame"))))
    joined = F.aggregate(F.col("frames"), F.lit(b""), lambda s, f: F.concat(s, f["frame"]))
    head = F.concat(F.lit(b"DKIF" + struct.pack("<HH4sHHII", 0, 32, b"AV01", width, height, rate, scale)), little_endian(F.size("frames"), 4), F.lit(bytes(4)))
    return frames.groupBy(key).agg(body.alias("frames")).select(key, F.concat(head, joined).alias("file"))


# Open bitstream units


def leb128(data: bytes, at: int, end: int) -> tuple[int, int]:
    """Value and the place after it."""
    value = 0
    for k in range(8):
        if at + k >= end:
            raise Malformed("number runs past the end")
        byte = data[at + k]
        value |= (byte & 127) << (7 * k)
        if byte < 128:
            return value, at + k + 1
    raise Malformed("number of more than eight bytes")


def units(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Type, temporal and spatial layer, payload of each unit; the last one may do without a size."""
    at = 0
    while at < len(data):
        head = data[at]
        if head & 0x80:
            raise Malformed("forbidden bit set")
        layers, start = (0, 0), at + 1
        if head & 4:
            if start >= len(data):
                raise Malformed("unit header runs past the end")
            layers, start = (data[start] >> 5, data[start] >> 3 & 3), start + 1
        size = len(data) - start
        if head & 2:
            size, start = leb128(data, start, len(data))
        if start + size > len(data):
            raise Malformed("unit runs past the end of the data")
        yield head >> 3 & 15, *layers, data[start : start + size]
        at = start + size


def unit_bytes(kind, payload):
    """A unit with its size, as a Column."""
    return F.concat(F.unhex(F.lpad(F.hex(kind * 8 + 2), 2, "0")), bits.leb128_bytes(F.length(payload).cast("long")), payload)


def sized(payload):
    """Length-prefixed bytes (Annex B), as a Column."""
    return F.concat(bits.leb128_bytes(F.length(payload).cast("long")), payload)


def sized_parts(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each length-prefixed part."""
    end = len(data) if end is None else end
    while at < end:
        size, at = leb128(data, at, end)
        if at + size > end:
            raise Malformed("part runs past what holds it")
        yield at, data[at : at + size]
        at += size


def annexb_units(temporal_unit: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Frame unit, type, layers and payload of each unit of an Annex B temporal unit."""
    for n, (_, frame_unit) in enumerate(sized_parts(temporal_unit)):
        for _, unit in sized_parts(frame_unit):
            for found in units(unit):
                yield n, *found


# Matroska

_MASTERS = {0x18538067, 0x1F43B675, 0xA0}  # fixed values: segment, cluster, block group
_BLOCKS = {0xA3, 0xA1}  # simple block, block


def _vint(data: bytes, at: int, end: int, marker: bool) -> tuple[int, int] | None:
    if at >= end or not data[at]:
        return None
    size = 9 - data[at].bit_length()
    if at + size > end:
        return None
    value = int.from_bytes(data[at : at + size], "big")
    return (value if marker else value & ((1 << (7 * size)) - 1)), size


def mkv_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Track and data of the blocks of the first track that has any. What cannot be walked ends its level."""
    track, levels = None, [(0, len(data))]
    while levels:
        at, end = levels.pop()
        name = _vint(data, at, end, True) if at < end else None
        size = _vint(data, at + name[1], end, False) if name else None
        if not size:
            continue
        start = at + name[1] + size[1]
        stop = end if size[0] == (1 << (7 * size[1])) - 1 else start + size[0]
        if stop > end:
            continue
        levels.append((stop, end))
        if name[0] in _MASTERS:
            levels.append((start, stop))
        elif name[0] in _BLOCKS and (number := _vint(data, start, stop, False)):
            track = number[0] if track is None else track
            if number[0] == track and stop - start >= number[1] + 3:
                yield track, data[start + number[1] + 3 : stop]


def mkv_element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + ((1 << 56) | len(body)).to_bytes(8, "big") + body


def mkv_file(frames: list[bytes], track: int = 1) -> bytes:
    """A minimal file with the frames as simple blocks of one cluster."""
    blocks = b"".join(mkv_element(0xA3, bytes([0x80 | track]) + n.to_bytes(2, "big") + b"\x80" + f) for n, f in enumerate(frames))
    return mkv_element(0x1A45DFA3, b"") + mkv_element(0x18538067, mkv_element(0x1F43B675, blocks))


# MP4


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        kind = data[at + 4 : at + 8]
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _inside(data: bytes, span: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    for kind in path:
        span = next(((a, b) for k, a, b in _boxes(data, *span) if k == kind), None)
        if span is None:
            return None
    return span


def mp4_tables(data: bytes, codec: bytes = b"av01") -> Iterator[tuple[str, int, int, int]]:
    """Rows of the sample tables of the first track of the codec: ("size", sample, bytes, 0), ("chunk", number,
    offset, 0) and ("run", first chunk, samples a chunk, 0). Samples are where these meet, see ``mp4_samples``."""
    moov = _inside(data, (0, len(data)), b"moov")
    number = lambda at, n=4: int.from_bytes(data[at : at + n], "big")
    for kind, a, b in _boxes(data, *moov) if moov else ():
        tables = _inside(data, (a, b), b"mdia", b"minf", b"stbl") if kind == b"trak" else None
        described = _inside(data, tables, b"stsd") if tables else None
        if not described or data[described[0] + 12 : described[0] + 16] != codec:
            continue
        sizes, runs = _inside(data, tables, b"stsz"), _inside(data, tables, b"stsc")
        wide, chunks = 4, _inside(data, tables, b"stco")
        if not chunks:
            wide, chunks = 8, _inside(data, tables, b"co64")
        if not (sizes and runs and chunks):
            raise Malformed("track without sample tables")
        fixed = number(sizes[0] + 4)
        for k in range(number(sizes[0] + 8)):
            yield "size", k, fixed or number(sizes[0] + 12 + 4 * k), 0
        for k in range(number(chunks[0] + 4)):
            yield "chunk", k + 1, number(chunks[0] + 8 + wide * k, wide), 0
        for k in range(number(runs[0] + 4)):
            yield "run", number(runs[0] + 8 + 12 * k), number(runs[0] + 12 + 12 * k), 0
        return


def mp4_file(samples: list[bytes], per_chunk: int = 2) -> bytes:
    """A minimal file: samples in chunks, and their tables."""
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    number = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    data = b"".join(samples)
    starts = [16 + sum(map(len, samples[:k])) for k in range(0, len(samples), per_chunk)]
    runs = [(1, per_chunk)] + ([(len(starts), len(samples) - per_chunk * (len(starts) - 1))] if len(samples) % per_chunk else [])
    tables = box(b"stsd", bytes(12) + b"av01") + box(b"stsz", number(0, 0, len(samples), *map(len, samples)))
    tables += box(b"stsc", number(0, len(runs)) + b"".join(number(a, n, 1) for a, n in runs)) + box(b"stco", number(0, len(starts), *starts))
    return box(b"ftyp", b"") + box(b"mdat", data) + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", tables)))))


# Y4M


def y4m_frames(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Width, height, depth and packed 4:2:0 samples of each frame."""
    end = data.find(b"\n")
    if not data.startswith(b"YUV4MPEG2") or end < 0:
        raise Malformed("not a Y4M file")
    tags = {t[:1]: t[1:] for t in data[:end].decode("ascii").split()[1:]}
    width, height, depth = int(tags["W"]), int(tags["H"]), 10 if "p10" in tags.get("C", "") else 8
    size = (width * height + 2 * ((width + 1) // 2) * ((height + 1) // 2)) * (2 if depth > 8 else 1)
    at = end + 1
    while at < len(data):
        line = data.find(b"\n", at)
        if line < 0 or not data.startswith(b"FRAME", at) or line + 1 + size > len(data):
            raise Malformed("frame runs past the end of the file")
        yield width, height, depth, data[line + 1 : line + 1 + size]
        at = line + 1 + size


def y4m_file(frames, width: int, height: int, depth: int = 8, rate: int = 25):
    """A Column: header and frames (an array of packed samples)."""
    head = f"YUV4MPEG2 W{width} H{height} F{rate}:1 Ip C420{'p10' if depth == 10 else 'jpeg'}\n".encode()
    return F.concat(F.lit(head), F.aggregate(frames, F.lit(b""), lambda s, f: F.concat(s, F.lit(b"FRAME\n"), f)))
