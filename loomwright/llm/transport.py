"""MPEG transport streams as a media column (operator 3).

``store`` wraps bytes into a transport stream of one program with one private
elementary stream: program tables, PES packets with time stamps, random-access
points, clock references and continuity counters. ``parse`` reads any such
stream: it resynchronises on damage, checks the tables' checksums and the
continuity counters, reassembles elementary packets and lists time stamps.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, text_or_empty

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 0x06, 0xBD
CLOCK = 90_000

UNIT = 64  #: payloads are padded to a multiple of this
ACCESS_UNIT = 128 * UNIT  #: payload bytes in one elementary packet
RANDOM_EVERY = 4  #: every such access unit is a random-access point
TICKS = CLOCK // 25  #: between access units


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 29 & 0x0E) | 1]) + ((t >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((t << 1 & 0xFFFE) | 1).to_bytes(2, "big")


def store(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        part, t = payload[at : at + ACCESS_UNIT], k * TICKS & (1 << 33) - 1
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + part
        field_ = b""
        if k % RANDOM_EVERY == 0:  # random access and clock reference
            field_ = b"\x50" + (t << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - (1 + len(field_) if field_ else 0)
        first = data[:room]
        if len(first) < room:  # the whole packet is short: stuff it
            stuffing = room - len(first)
            if not field_:
                field_, stuffing = (b"", 0) if stuffing == 1 else (b"\x00", stuffing - 2)
            field_ += b"\xff" * stuffing
            extra = bytes([len(field_)]) + field_
        else:
            extra = bytes([len(field_)]) + field_ if field_ else b""
        out.append(bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 255, (0x30 if extra else 0x10) | counter]) + extra + first)
        counter = counter + 1 & 15
        rest = data[room:]
        n, tail = divmod(len(rest), PACKET - 4)
        if n:
            block = np.empty((n, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
            block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, n * (PACKET - 4)).reshape(n, PACKET - 4)
            out.append(block.tobytes())
            counter = counter + n & 15
        if tail:
            stuffing = PACKET - 5 - tail
            extra = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter]) + extra + rest[n * (PACKET - 4) :])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    pid: int
    type: int
    program: int
    packets: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    data: bytes = b""
    #: of each elementary packet: time stamps (or None), random access, offset in ``data``, size
    units: list[tuple] = field(default_factory=list)


@dataclass
class Report:
    packets: int = 0
    skipped_bytes: int = 0
    flawed_packets: int = 0
    table_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: list[Stream] = field(default_factory=list)


def _aligned(data: bytes) -> tuple[np.ndarray, int]:
    """Packets of 188 bytes that begin with the sync byte, and the bytes between them."""
    a = np.frombuffer(data, np.uint8)
    n = len(a) // PACKET
    whole = a[: n * PACKET].reshape(n, PACKET)
    if n * PACKET == len(a) and (whole[:, 0] == SYNC).all():
        return whole, 0
    at, found = 0, []
    while at + PACKET <= len(a):
        if a[at] == SYNC and (at + 2 * PACKET > len(a) or a[at + PACKET] == SYNC):
            found.append(at)
            at += PACKET
        else:
            nxt = data.find(bytes([SYNC]), at + 1)
            at = len(a) if nxt < 0 else nxt
    rows = np.stack([a[i : i + PACKET] for i in found]) if found else np.zeros((0, PACKET), np.uint8)
    return rows, len(a) - len(found) * PACKET


def _sections(rows: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], int]:
    """Complete table sections with the right checksum, and the number of others."""
    good, bad, open_ = [], 0, b""

    def take(buffer: bytes) -> bytes:
        nonlocal bad
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + ((buffer[1] & 15) << 8 | buffer[2])
            if len(buffer) < size:
                return buffer
            section, buffer = buffer[:size], buffer[size:]
            if size >= 12 and crc32_mpeg(section) == 0:
                good.append(section)
            else:
                bad += 1
        return b""

    for row, at, start in zip(rows, begin.tolist(), starts.tolist(), strict=True):
        body = row[at:].tobytes()
        if start and body:
            pointer = body[0]
            if open_:
                take(open_ + body[1 : 1 + pointer])
            open_ = take(body[1 + pointer :])
        elif open_:
            open_ = take(open_ + body)
    return good, bad + bool(open_)


def _read_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | (b[1] << 8 | b[2]) >> 1 << 15 | (b[3] << 8 | b[4]) >> 1


def _elementary(rows: np.ndarray, begin: np.ndarray, starts: np.ndarray, random: np.ndarray, stream: Stream) -> None:
    size = PACKET - begin
    joined = rows[np.arange(PACKET)[None, :] >= begin[:, None]].tobytes()
    at = np.cumsum(size) - size
    first = np.flatnonzero(starts)
    limits = [*at[first].tolist(), len(joined)]
    parts, offset = [], 0
    for i, a, b in zip(first.tolist(), limits[:-1], limits[1:], strict=True):
        unit = joined[a:b]
        if len(unit) < 9 or unit[:3] != b"\x00\x00\x01":
            continue
        declared, flags, header = unit[4] << 8 | unit[5], unit[7] >> 6, 9 + unit[8]
        pts = _read_stamp(unit[9:14]) if flags & 2 and len(unit) >= 14 else None
        dts = _read_stamp(unit[14:19]) if flags == 3 and len(unit) >= 19 else pts
        body = unit[header : 6 + declared] if declared else unit[header:]
        stream.units.append((pts, dts, bool(random[i]), offset, len(body)))
        parts.append(body)
        offset += len(body)
    stream.data = b"".join(parts)


def parse(data: bytes) -> Report:
    """What a transport stream holds. Damaged parts are counted and left out; no input raises."""
    rows, skipped = _aligned(data)
    report = Report(packets=len(rows), skipped_bytes=skipped)
    if not len(rows):
        return report
    wide = rows[:, :6].astype(np.int64)
    pid = (wide[:, 1] & 0x1F) << 8 | wide[:, 2]
    control, extra = wide[:, 3] >> 4 & 3, wide[:, 4]
    has_field, has_body = (control & 2) > 0, (control & 1) > 0
    begin = np.where(has_field, 5 + extra, 4)
    flawed = (wide[:, 1] & 0x80 > 0) | (begin > PACKET)
    report.flawed_packets = int(flawed.sum())
    begin = np.minimum(begin, PACKET)
    flags = np.where(has_field & (extra > 0), wide[:, 5], 0)
    starts = wide[:, 1] & 0x40 > 0
    use = ~flawed & (pid != NULL_PID)

    def table(of: int) -> list[bytes]:
        at = np.flatnonzero(use & has_body & (pid == of))
        good, bad = _sections(rows[at], begin[at], starts[at])
        report.table_errors += bad
        return good

    for s in table(PAT_PID):
        if s[0] == 0:
            for k in range(8, len(s) - 4, 4):
                number, target = s[k] << 8 | s[k + 1], (s[k + 2] & 0x1F) << 8 | s[k + 3]
                if number:
                    report.programs[number] = target
    listed: dict[int, Stream] = {}
    for number, target in report.programs.items():
        for s in table(target):
            if s[0] != 2 or (s[3] << 8 | s[4]) != number:
                continue
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                es = (s[k + 1] & 0x1F) << 8 | s[k + 2]
                listed.setdefault(es, Stream(es, s[k], number))
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for es, stream in sorted(listed.items()):
        at = np.flatnonzero(use & (pid == es))
        stream.packets = len(at)
        body = at[has_body[at]]
        counter = wide[body, 3] & 15
        step = np.diff(counter) & 15
        again = np.zeros(len(body), bool)
        again[1:] = (step == 0) & (rows[body[1:], 4:] == rows[body[:-1], 4:]).all(1)  # a packet may be sent twice
        announced = flags[body[1:]] & 0x80 > 0
        stream.duplicates = int(again.sum())
        stream.continuity_errors = int(((step != 1) & ~again[1:] & ~announced).sum())
        keep = body[~again]
        _elementary(rows[keep], begin[keep], starts[keep], flags[keep] & 0x40 > 0, stream)
        report.streams.append(stream)
    return report


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 of ``text`` with zero bytes up to a positive multiple of 64, and its own length."""
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0"), len(data)


def feature(report: Report) -> str:
    """Programs, and of each stream its packets, faults, elementary packets, random-access points and time span."""
    parts = [f"packets={report.packets} skipped={report.skipped_bytes} flawed={report.flawed_packets} tables={report.table_errors} programs={len(report.programs)}"]
    for s in report.streams:
        stamps = [u[0] for u in s.units if u[0] is not None]
        parts.append(
            f"pid={s.pid} type={s.type} packets={s.packets} continuity={s.continuity_errors} duplicates={s.duplicates} pes={len(s.units)} "
            f"random={sum(u[2] for u in s.units)} pts={min(stamps, default=-1)}-{max(stamps, default=-1)} bytes={len(s.data)}"
        )
    return ";".join(parts)


UNIT_TYPE = "array<struct<pts:long,dts:long,random_access:boolean,offset:long,size:long>>"
STREAM_TYPE_SQL = f"array<struct<pid:int,type:int,program:int,packets:long,continuity_errors:long,duplicates:long,data:binary,units:{UNIT_TYPE}>>"


def parse_column(df: DataFrame, key: str, media: str) -> DataFrame:
    """Parse a binary column of transport streams: one row per input row, a null stream counts as empty.

    Columns: key, packets, skipped_bytes, flawed_packets, table_errors,
    programs (number -> table PID), streams (elementary data, time stamps and
    random-access points).
    """
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, packets long, skipped_bytes long, flawed_packets long, table_errors long, programs map<int,int>, streams {STREAM_TYPE_SQL}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = parse(data or b"")
                streams = [{**{n: getattr(s, n) for n in ("pid", "type", "program", "packets", "continuity_errors", "duplicates", "data")}, "units": [dict(zip(("pts", "dts", "random_access", "offset", "size"), u, strict=True)) for u in s.units]} for s in r.streams]
                rows.append({"key": k, "packets": r.packets, "skipped_bytes": r.skipped_bytes, "flawed_packets": r.flawed_packets, "table_errors": r.table_errors, "programs": list(r.programs.items()), "streams": streams})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media")).mapInArrow(in_pieces(run), schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the transport stream (``media``) of each row's whole text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            made = [padded(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([store(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(in_pieces(run), "doc_id long, n_bytes long, media binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each row's whole text as a transport stream, read the stream back, and describe both.

    Null and empty texts are 64 zero bytes; equal texts give equal values;
    repeated rows give repeated results.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                payload, n = padded(text or "")
                media = store(payload)
                report = parse(media)
                back = report.streams[0].data if report.streams else b""
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(report)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(in_pieces(run), schema)
