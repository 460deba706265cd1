"""Media columns as MPEG transport streams.

The reader looks at all 188-byte packets at once: headers as columns of a matrix, program tables from the few
packets that hold them, continuity counters by stream, and the stream's packetised units from the bytes between
two unit starts, with their time stamps and random-access points. The writer stores any bytes as a private data
stream: program tables, units of UNIT bytes with a time stamp each, and every RANDOM_EVERY-th as a random-access
point with a clock reference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

PACKET, SYNC = 188, 0x47
#: The payload's granule, payload bytes of a unit, and units from one random-access point to the next.
GRANULE, UNIT, RANDOM_EVERY = 192, 192 * 32, 8
#: Where the writer puts the tables and the data, its stream type (private data) and stream id.
PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0101, 0x06, 0xBD
#: Units of the 90 kHz clock between two units.
TICKS = 3600
#: Stream ids whose units have no time stamps or header extension.
BARE = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    """A packet that holds one short section, at counter 0."""
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
)


def _stamp(mark: int, t: int) -> bytes:
    """33 bits of a time stamp with its marker bits."""
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _clock(t: int) -> bytes:
    """The adaptation field's clock reference: 33 bits of base, an extension of zero."""
    return bytes([t >> 25 & 0xFF, t >> 17 & 0xFF, t >> 9 & 0xFF, t >> 1 & 0xFF, (t & 1) << 7 | 0x7E, 0])


def _unit_packets(unit: bytes, t: int, random: bool) -> np.ndarray:
    """Packets of one unit, counters not yet set: the first has the flags, the last is stuffed by its adaptation field."""
    body = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + unit
    first = b"\x07\x50" + _clock(t) if random else b""
    n = -(-(len(body) + len(first)) // 184)
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x10
    out[0, 1] |= 0x40
    spare = n * 184 - len(body) - len(first)
    data = np.frombuffer(body, np.uint8)
    if n == 1:
        adaptation = b""
        if length := len(first) + spare:
            adaptation = bytes([length - 1]) + (first[1:] or b"\0" * (length > 1)).ljust(length - 1, b"\xff")
            out[0, 3] = 0x30
        out[0, 4:] = np.frombuffer(adaptation + body, np.uint8)
        return out
    room = 184 - len(first)
    out[0, 4:] = np.frombuffer(first + body[:room], np.uint8)
    if first:
        out[0, 3] = 0x30
    middle = room + (n - 2) * 184
    out[1 : n - 1, 4:] = data[room:middle].reshape(n - 2, 184)
    stuffing = bytes([spare - 1]) + (b"\0" * (spare > 1)).ljust(spare - 1, b"\xff") if spare else b""
    out[n - 1, 3] = 0x30 if spare else 0x10
    out[n - 1, 4:] = np.frombuffer(stuffing + body[middle:], np.uint8)
    return out


def write(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    parts = [_unit_packets(payload[i : i + UNIT], i // UNIT * TICKS, i // UNIT % RANDOM_EVERY == 0) for i in range(0, len(payload), UNIT)]
    if not parts:
        return TABLES
    packets = np.concatenate(parts)
    packets[:, 3] |= (np.arange(len(packets)) & 15).astype(np.uint8)
    return TABLES + packets.tobytes()


@dataclass
class Stream:
    """One elementary stream: its units' payloads, and of each unit the time stamps (-1: none) and whether it begins at a random-access point."""

    pid: int
    kind: int
    units: list[bytes] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    dts: list[int] = field(default_factory=list)
    random: list[bool] = field(default_factory=list)
    packets: int = 0
    gaps: int = 0
    repeats: int = 0


@dataclass
class Reading:
    packets: int = 0
    bad_sync: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Stream] = field(default_factory=dict)
    bad_tables: int = 0


def _sections(data: bytes) -> Iterator[bytes]:
    """Whole sections with a right checksum from the payloads of a table's packets, each with a pointer before the first."""
    at = 0
    while at + 3 <= len(data) and data[at] != 0xFF:
        size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)
        if at + size <= len(data):
            yield data[at : at + size]
        at += size


def _table(packets: np.ndarray, begin: np.ndarray, starts: np.ndarray, r: Reading, table_id: int) -> list[bytes]:
    """The distinct valid sections in these packets of one pid."""
    runs: list[bytearray] = []
    for p, b, s in zip(packets, begin.tolist(), starts.tolist(), strict=True):
        body = p[b:].tobytes() if b < PACKET else b""
        if not body:
            continue
        if s:
            skip = body[0]
            if runs:
                runs[-1] += body[1 : 1 + skip]
            runs.append(bytearray(body[1 + skip :]))
        elif runs:
            runs[-1] += body
    found = []
    for x in dict.fromkeys(bytes(run) for run in runs):
        for section in _sections(x):
            if section[0] != table_id:
                continue
            if len(section) < 12 or crc32_mpeg(section):
                r.bad_tables += 1
            elif section[5] & 1:
                found.append(section)
    return found


def _time(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def read(data: bytes) -> Reading:
    """Parses a transport stream; packets out of sync, with a transport error or scrambled are left out and counted as gaps."""
    r = Reading()
    whole = np.frombuffer(data, np.uint8)
    if len(whole) >= PACKET and whole[0] != SYNC:  # look for the first byte from which packets follow each other
        at = np.flatnonzero(whole[: PACKET] == SYNC)
        at = [a for a in at.tolist() if (whole[a::PACKET][:5] == SYNC).all()]
        whole = whole[at[0] :] if at else whole[:0]
    m = whole[: len(whole) // PACKET * PACKET].reshape(-1, PACKET)
    r.packets = len(m)
    good = (m[:, 0] == SYNC) & (m[:, 1] < 0x80) & (m[:, 3] < 0x40)
    r.bad_sync = int((~good).sum())
    m = m[good]
    pid = (m[:, 1] & 0x1F).astype(np.int32) << 8 | m[:, 2]
    start, control, counter = (m[:, 1] & 0x40) > 0, m[:, 3] >> 4 & 3, m[:, 3] & 15
    begin = np.where(control == 1, 4, np.where(control == 3, 5 + m[:, 4].astype(np.int32), PACKET))
    flags = np.where((control >= 2) & (m[:, 4] > 0), m[:, 5], 0)
    of = lambda p: np.flatnonzero(pid == p)
    at = of(0)
    for section in _table(m[at], begin[at], start[at], r, 0):
        for i in range(8, len(section) - 4, 4):
            number, where = int.from_bytes(section[i : i + 2], "big"), int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
            if number:
                r.programs[number] = where
    for where in dict.fromkeys(r.programs.values()):
        at = of(where)
        for section in _table(m[at], begin[at], start[at], r, 2):
            i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while i + 5 <= len(section) - 4:
                p = int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF
                r.streams.setdefault(p, Stream(p, section[i]))
                i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
    for s in r.streams.values():
        at = of(s.pid)
        at = at[control[at] & 1 == 1]  # the counter moves with payloads only
        s.packets = len(at)
        if not len(at):
            continue
        step = np.diff(counter[at].astype(np.int16)) & 15
        same = np.concatenate(([False], (step == 0) & (m[at[1:], 4:] == m[at[:-1], 4:]).all(axis=1)))
        told = np.concatenate(([True], (flags[at[1:]] & 0x80) > 0))  # the stream says that it begins anew
        s.repeats = int(same.sum())
        lost = ~same & ~told & np.concatenate(([False], step != 1))
        s.gaps = int(lost.sum())
        at, lost = at[~same], lost[~same]
        first = np.flatnonzero(start[at])
        bounds = np.append(first, len(at))
        column = np.arange(PACKET)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if lost[a + 1 : b].any():
                continue  # part of the unit is missing
            k = at[a:b]
            inner = m[k]
            body = inner[column >= begin[k][:, None]].tobytes() if (begin[k] > 4).any() else inner[:, 4:].tobytes()
            if body[:3] != b"\0\0\1" or len(body) < 6:
                continue
            size = int.from_bytes(body[4:6], "big")
            body_end = 6 + size if size else len(body)
            if body_end > len(body):
                continue
            pts = dts = -1
            skip = 6
            if body[3] not in BARE:
                skip = 9 + body[8]
                if body[7] & 0x80:
                    pts = dts = _time(body[9:14])
                if body[7] & 0xC0 == 0xC0:
                    dts = _time(body[14:19])
            s.units.append(body[skip:body_end])
            s.pts.append(pts)
            s.dts.append(dts)
            s.random.append(bool(flags[k[0]] & 0x40))
    return r


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of text, spaces added up to a positive multiple of GRANULE, and the size without them."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // GRANULE)) * GRANULE), len(raw)


def stored(df: DataFrame, text_col: str, media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """df with the column media, the stream that holds each row's padded text, and its size without padding.

    Narrow. Null text is empty: a granule of spaces. Other columns pass through; those named like the results are replaced.
    """
    keep = [c for c in df.columns if c not in (media_col, size_col)]
    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                pairs = [payload_of(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([write(p) for p, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.int64())], names=[*keep, media_col, size_col])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add(media_col, "binary").add(size_col, "long"))


FACTS = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
    "n_programs": "int", "n_streams": "int", "n_packets": "long", "n_gaps": "long", "n_units": "long", "pts": "array<long>", "random_access": "array<long>",
}


def inspected(df: DataFrame, media_col: str = "media", keep_payload: bool = False) -> DataFrame:
    """df without media, with what the stream holds: FACTS and, if asked for, the payload read back.

    payload joins the units of all streams by pid, then in order; pts lists their time stamps (-1: none) and
    random_access the time stamps of the random-access points. Null media counts as an empty stream. A unit that
    a continuity gap cuts is left out and shows in n_gaps.
    """
    new = FACTS | ({"payload": "binary"} if keep_payload else {})
    keep = [c for c in df.columns if c not in new and c != media_col]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media_col}`").alias(media_col))
    schema = StructType(list(rows.schema.fields)[:-1] + StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
        for b in batches:
            out: list[tuple] = []
            for x in b.column(b.num_columns - 1):
                media = x.as_py() or b""
                r = read(media)
                streams = [r.streams[p] for p in sorted(r.streams)]
                payload = b"".join(u for s in streams for u in s.units)
                pts = [t for s in streams for t in s.pts]
                random = [t for s in streams for t, k in zip(s.pts, s.random, strict=True) if k]
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(r.programs), len(streams), r.packets, sum(s.gaps for s in streams) + r.bad_sync, len(pts), pts, random)
                out.append((*row, payload) if keep_payload else row)
            cols = list(zip(*out, strict=True)) if out else [()] * len(new)
            arrays = [pa.array(c, kinds[k]) for c, k in zip(cols, new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*keep, *new])

    return rows.mapInArrow(run, schema)


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a transport stream, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    facts = inspected(stored(docs, "text").drop("text"))
    feature = F.format_string(
        "programs=%d;streams=%d;packets=%d;gaps=%d;units=%d;first_pts=%d;last_pts=%d;random_access=%d",
        "n_programs", "n_streams", "n_packets", "n_gaps", "n_units",
        F.coalesce(F.array_min("pts"), F.lit(-1)), F.coalesce(F.array_max("pts"), F.lit(-1)), F.size("random_access"),
    )
    return facts.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
