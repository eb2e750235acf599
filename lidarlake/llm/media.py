"""Media columns: payloads stored as MPEG transport streams.

A payload is cut into access units, each a packetised elementary stream (PES) packet of private data with a 90 kHz
presentation timestamp. Each PES packet is spread over 188-byte transport packets; the first one of every
`rap_every`-th unit carries the random-access flag and comes after fresh program tables (PAT and PMT).

Reading follows the standard: a packet without payload keeps its counter, a packet may be sent twice, a marked
discontinuity is none, and sections of program tables may take several packets.

Nulls and empty texts are the empty payload, padded to one 64-byte block, so every row has a stream; a null stream is read
as nulls. Rows with equal texts give equal values, repeated rows too; a null doc_id stays null. Long texts make as many
units as they need. Extra columns are not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, lean, narrow, pieces

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
UNIT_BYTES, RAP_EVERY, TICKS = 4096, 8, 3600
BLOCK = 64


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
PMT = _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)))


def _timestamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1))


def _counted(packet: bytes, counter: int) -> bytes:
    return packet[:3] + bytes((packet[3] & 0xF0 | counter & 15,)) + packet[4:]


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES, rap_every: int = RAP_EVERY) -> bytes:
    """The transport stream of a payload."""
    out: list[bytes] = []
    counter = tables = 0
    for k in range(max(1, -(-len(payload) // unit_bytes))):
        unit = payload[k * unit_bytes : (k + 1) * unit_bytes]
        pts, rap = k * TICKS & 0x1FFFFFFFF, k % rap_every == 0
        if rap:
            out += (_counted(PAT, tables), _counted(PMT, tables))
            tables += 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + _timestamp(pts) + unit
        # the first packet: a clock reference, and the flag for random access
        extra = bytes(((0x50 if rap else 0x10),)) + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        at, room = 0, PACKET - 5 - len(extra)
        first = True
        while first or at < len(pes):
            part = pes[at : at + room]
            head = struct.pack(">BH", SYNC, (0x4000 if first else 0) | DATA_PID)
            short = room - len(part)
            if first:
                out.append(head + bytes((0x30 | counter, len(extra) + short)) + extra + b"\xff" * short + part)
            elif short == 0:
                out.append(head + bytes((0x10 | counter,)) + part)
            else:
                stuffing = b"\0" + b"\xff" * (short - 2) if short > 1 else b""
                out.append(head + bytes((0x30 | counter, short - 1)) + stuffing + part)
            counter = counter + 1 & 15
            at += len(part)
            room, first = PACKET - 4, False
    return b"".join(out)


class Stream(NamedTuple):
    payload: bytes
    pts: list[int]
    random_access: list[int]  # indexes of units that start with a random-access point
    packets: int
    continuity_errors: int


def _in_order(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Packets of one PID that carry payload, repeated ones once, and how many counters are out of order."""
    carries, counter = (rows[:, 3] & 0x10) != 0, (rows[:, 3] & 15).astype(np.int16)
    marked = ((rows[:, 3] & 0x20) != 0) & (rows[:, 4] > 0) & ((rows[:, 5] & 0x80) != 0)
    step = np.diff(counter) & 15
    again = np.zeros(len(rows), bool)
    again[1:] = carries[1:] & carries[:-1] & (step == 0) & (rows[1:] == rows[:-1]).all(axis=1)
    again[2:] &= ~again[1:-1]  # twice, not more often
    right = (step == carries[1:]) | again[1:] | marked[1:]
    return rows[carries & ~again], int((~right).sum())


def _payload_at(rows: np.ndarray) -> np.ndarray:
    return 4 + np.where((rows[:, 3] & 0x20) != 0, rows[:, 4].astype(np.int32) + 1, 0)


def _sections(rows: np.ndarray, table_id: int) -> list[bytes]:
    """The sections of a program table, put together over packets and checked."""
    out, held = [], b""

    def done(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF and len(data) >= (size := 3 + ((data[1] & 0x0F) << 8 | data[2])):
            if data[0] != table_id or section_crc(data[:size]):
                raise ValueError("damaged program table")
            out.append(data[:size])
            data = data[size:]
        return data

    for row, at in zip(rows, _payload_at(rows).tolist(), strict=True):
        body = row[at:].tobytes()
        if row[1] & 0x40:
            begin = 1 + body[0]
            if held:
                done(held + body[1:begin])
            held = done(body[begin:])
        elif held:
            held = done(held + body)
    if not out:
        raise ValueError("no whole program table")
    return out


def demux(stream: bytes) -> Stream:
    """Parse the program tables, check the continuity counters and put the elementary packets together again."""
    if len(stream) % PACKET:
        raise ValueError("not whole transport packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost sync byte")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    tables, errors = _in_order(rows[pids == PAT_PID])
    pat = _sections(tables, 0)
    if any(s != pat[0] for s in pat[1:]):
        raise ValueError("program tables differ")
    pmt_pid = struct.unpack(">H", pat[0][10:12])[0] & 0x1FFF
    tables, more = _in_order(rows[pids == pmt_pid])
    pmt = _sections(tables, 2)[0]
    info = struct.unpack(">H", pmt[10:12])[0] & 0x0FFF
    data_pid = struct.unpack(">H", pmt[13 + info : 15 + info])[0] & 0x1FFF
    mine, most = _in_order(rows[pids == data_pid])
    errors += more + most
    begins = np.flatnonzero((mine[:, 1] & 0x40) != 0)
    adapted = (mine[:, 3] & 0x20) != 0
    offset = _payload_at(mine)
    sizes = PACKET - offset
    joined = mine[np.arange(PACKET)[None, :] >= offset[:, None]].tobytes()
    at = np.concatenate(([0], np.cumsum(sizes)))
    flagged = adapted[begins] & (mine[begins, 4] > 0) & ((mine[begins, 5] & 0x40) != 0)
    bodies, pts = [], []
    for x in at[begins].tolist():
        code, length, _, _, header = struct.unpack(">IHBBB", joined[x : x + 9])
        if code != 0x100 | PRIVATE_STREAM:
            raise ValueError("not the start of an elementary packet")
        t = joined[x + 9 : x + 14]
        pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        bodies.append(joined[x + 9 + header : x + 6 + length])
    return Stream(b"".join(bodies), pts, np.flatnonzero(flagged).tolist(), len(rows), errors)


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\0")


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("payload", pa.binary()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32())), ("packets", pa.int32()), ("continuity_errors", pa.int32()), ("error", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES, rap_every: int = RAP_EVERY) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a transport stream. Null text: the empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = [padded(t) for t in b.column("text").to_pylist()]
            yield batch_of(_MEDIA, [b.column("doc_id"), [n for n, _ in made], [mux(p, unit_bytes, rap_every) for _, p in made]])

    return narrow(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, payload, pts, random_access, packets, continuity_errors, error) of stored streams. A null stream gives
    nulls; of one that cannot be read, one without a byte included, `error` tells why and the rest is null."""

    def read(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        try:
            if not media:
                raise ValueError("no packet")
            return (*demux(media)[:5], None)
        except (ValueError, struct.error, IndexError) as e:
            return (*(None,) * 5, str(e) or type(e).__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            rows = [read(m) for m in b.column("media").to_pylist()]
            yield batch_of(_DECODED, [b.column("doc_id"), *zip(*rows, strict=True)])

    return narrow(media, doc_id=(id_col, "long"), media=(media_col, "binary")).mapInArrow(lean(run), "doc_id long, payload binary, pts array<long>, random_access array<int>, packets int, continuity_errors int, error string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stream in a media column, and what is read back from that column.

    feature: units, packets, continuity errors, last timestamp, and the timestamps at random-access points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            rows = []
            for media in b.column("media").to_pylist():
                s = demux(media)
                raps = ":".join(str(s.pts[i]) for i in s.random_access)
                feature = f"units={len(s.pts)};packets={s.packets};cc_errors={s.continuity_errors};last_pts={s.pts[-1]};rap_pts={raps}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield batch_of(_DIGEST, [b.column("doc_id"), b.column("n_bytes"), *zip(*rows, strict=True)])

    return encode(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
