"""MPEG transport streams as a media column: mux bytes, and demux them with timestamps and random-access points.

A stream is PAT, PMT (one private-data program element), then PES packets of at most PES_BYTES payload bytes cut into
188-byte packets. Each PES packet has a PTS; every GOP-th starts with the random-access flag and a PCR. Demuxing
parses the tables to find the element's PID, checks continuity counters, and reassembles the PES packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship, written

PACKET, BODY = 188, 184
PMT_PID, DATA_PID, STREAM_ID, STREAM_TYPE = 0x1000, 0x0100, 0xBD, 0x06
PES_BYTES = 32_000
GOP = 4
TICKS = 3_600
#: The generator of the tables' CRC-32.
CRC_POLY = 0x04C11DB7


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLY if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\x00" + section).ljust(PACKET, b"\xff")


def _stamp(n: int, mark: int) -> bytes:
    return struct.pack(">BHH", mark << 4 | (n >> 29 & 0x0E) | 1, (n >> 14 & 0xFFFE) | 1, (n << 1 & 0xFFFE) | 1)


def _unstamp(b: bytes) -> int:
    a, m, c = struct.unpack(">BHH", b)
    return (a >> 1 & 7) << 30 | (m >> 1) << 15 | c >> 1


TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000)))


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream. An empty payload gives the tables alone."""
    out, cc = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        part, pts = payload[at : at + PES_BYTES], k * TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, len(part) + 8, 0x84, 0x80, 5) + _stamp(pts, 2) + part
        pos, first = 0, True
        while pos < len(pes):
            field = b""
            if first and k % GOP == 0:  # random access: PCR of 33 bits at 90 kHz, extension 0
                field = b"\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
            room = BODY - (len(field) + 1 if field else 0)
            left = len(pes) - pos
            if left < room:
                stuff = room - left
                if not field:
                    field = b"" if stuff == 1 else b"\x00" + b"\xff" * (stuff - 2)
                    adapt = bytes([len(field)]) + field
                else:
                    field += b"\xff" * stuff
                    adapt = bytes([len(field)]) + field
                take = left
            else:
                adapt, take = (bytes([len(field)]) + field) if field else b"", room
            out.append(struct.pack(">BHB", 0x47, (0x4000 if first else 0) | DATA_PID, (0x30 if adapt else 0x10) | cc) + adapt + pes[pos : pos + take])
            pos, cc, first = pos + take, cc + 1 & 15, False
    return b"".join(out)


def _section_body(stream: bytes, body: int, end: int) -> bytes:
    """What a table section holds between its head and its CRC, by its own length; the pointer field is followed."""
    at = body + 1 + stream[body]
    n = struct.unpack_from(">H", stream, at + 1)[0] & 0xFFF if at + 3 <= end else end
    if at + 3 + n > end:
        raise ValueError("a table that spans packets")
    if crc32_mpeg(stream[at : at + 3 + n]):
        raise ValueError("table CRC")
    return stream[at + 8 : at + 3 + n - 4]


def _program_map(pat: bytes) -> int | None:
    """PID of the first program's map; program 0 names the network and is passed over."""
    for number, pid in struct.iter_unpack(">HH", pat[: len(pat) // 4 * 4]):
        if number:
            return pid & 0x1FFF
    return None


def _elements(pmt: bytes) -> list[tuple[int, int]]:
    """(stream type, PID) of each element of a program map, descriptors passed over by their lengths."""
    at, out = 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0xFFF), []
    while at + 5 <= len(pmt):
        kind, pid, n = struct.unpack_from(">BHH", pmt, at)
        out.append((kind, pid & 0x1FFF))
        at += 5 + (n & 0xFFF)
    return out


def demux(stream: bytes) -> dict:
    """payload, PES count, PTS list, random-access byte offsets, packets, continuity errors, orphans and PID of a stream.

    The element is the first private-data one of the first program, else its first one. A packet that repeats its
    predecessor's counter with equal bytes is dropped (legal once); packets without payload do not count; a jump of
    the counter is a gap unless the discontinuity flag announces it; payload before the first start is dropped and
    counted as orphan. A damaged table, a lost sync byte or a PES packet that is not whole is an error.
    """
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    pmt = pid = None
    parts: list[list[bytes]] = []
    access, last, gaps, orphans = [], None, 0, 0
    before = b""
    for at in range(0, len(stream), PACKET):
        sync, word, flags = struct.unpack_from(">BHB", stream, at)
        if sync != 0x47:
            raise ValueError("lost sync")
        got, start, body, end = word & 0x1FFF, word & 0x4000, at + 4, at + PACKET
        if got == pid:
            mark = announced = False
            if flags & 0x20:
                n = stream[body]
                if n:
                    announced, mark = bool(stream[body + 1] & 0x80), bool(stream[body + 1] & 0x40)
                body += 1 + n
            if not flags & 0x10:
                continue
            cc, packet = flags & 15, stream[at:end]
            if last == cc and packet == before:
                continue
            if last is not None and cc != last + 1 & 15 and not announced:
                gaps += 1
            last, before = cc, packet
            if mark:
                access.append(at)
            if start:
                parts.append([])
            if parts:
                parts[-1].append(stream[body:end])
            else:
                orphans += 1
        elif not flags & 0x10:
            continue
        elif got == 0:
            pmt = _program_map(_section_body(stream, body + (1 + stream[body] if flags & 0x20 else 0), end))
        elif got == pmt:
            found = _elements(_section_body(stream, body + (1 + stream[body] if flags & 0x20 else 0), end))
            pid = next((p for k, p in found if k == STREAM_TYPE), found[0][1] if found else None)
    payload, pts = [], []
    for p in parts:
        pes = b"".join(p)
        n = struct.unpack(">H", pes[4:6])[0]
        if pes[:4] != b"\x00\x00\x01" + bytes([STREAM_ID]) or len(pes) != n + 6:
            raise ValueError("PES packet is not whole")
        pts.append(_unstamp(pes[9:14]))
        payload.append(pes[9 + pes[8] :])
    return {"payload": b"".join(payload), "pes": len(parts), "pts": pts, "access": access, "packets": len(stream) // PACKET, "gaps": gaps, "orphans": orphans, "pid": pid}


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\x00" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def feature(d: dict) -> str:
    """Text form of the stream's shape: packets, PES packets, last timestamp, random-access offsets, continuity gaps."""
    return f"packets={d['packets']};pes={d['pes']};pid={d['pid']};last_pts={d['pts'][-1] if d['pts'] else -1};access={'/'.join(map(str, d['access']))};gaps={d['gaps']}"


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def store(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """docs (all columns but an old `to`) with the binary transport stream of each text; null text is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(b.schema.get_field_index(text)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([mux(padded(x)[0]) for x in t], pa.binary())], names=[*b.schema.names, to])

    ship(docs.sparkSession)
    docs = docs.drop(to)
    return docs.mapInArrow(run, f"{_fields(docs)}, `{to}` binary")


def read(stored: DataFrame, media: str = "media", length: str = "n_bytes") -> DataFrame:
    """stored without its media column, and COLUMNS from each stream's bytes; `length` names the unpadded byte count.

    Timestamps (90 kHz) and random-access points (byte offsets) are arrays. A stream with gaps or orphans is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            at = b.schema.get_field_index(media)
            for m in b.column(at).to_pylist():
                d = demux(m)
                back = d["payload"]
                if d["gaps"] or d["orphans"]:
                    raise ValueError("stream has gaps")
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(d), d["pts"], d["access"]))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), longs, longs]
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*[b.schema.names[i] for i in keep], *names])

    ship(stored.sparkSession)
    fields = [f for f in COLUMNS.split(", ") if not f.startswith("n_bytes ")]
    names = [f.split()[0] for f in fields]
    kept = stored.drop(media)
    return stored.mapInArrow(run, f"{_fields(kept)}, {', '.join(fields)}")


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and COLUMNS. Streams are written to the shared folder as a media column, and read back from there.

    Null text is the empty text, whose payload is 64 zero bytes. Equal texts give equal values; repeated rows are kept,
    an empty table gives no rows, and other columns (clashing names too) are ignored.
    """
    n = F.octet_length(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).cast("long")
    media = store(docs.select(F.col(key).alias("k"), n.alias("n_bytes"), F.col(text).alias("t")), "t").drop("t")
    return read(written(media, "media")).withColumnRenamed("k", key)
