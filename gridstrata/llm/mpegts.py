"""Media columns: MPEG transport streams (ISO/IEC 13818-1) as a binary column.

mux() stores a byte payload losslessly as one program with one private elementary stream: a program association table, a
program map table, then one PES packet per access unit with a presentation time stamp, cut into 188-byte packets.
Every KEY_EVERY-th access unit is marked as a random-access point. demux() reads the stored bytes back: it checks sync
bytes, finds the stream through both tables (with their CRCs), checks continuity counters, reassembles the PES packets
and lists their time stamps, random-access flags and byte ranges in the payload.

A null or empty input has the payload of one block of fill bytes. Equal inputs give equal streams. Damaged streams: bad
sync, a missing table or a bad CRC raise; lost or repeated packets are counted in continuity_errors.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed values of the format.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
PRIVATE_STREAM, PRIVATE_PES = 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

#: Our own choices: payload block and fill byte, where tables and stream go, access unit, its duration, key interval.
BLOCK, FILL = 576, 255
PROGRAM, PMT_PID, STREAM_PID = 1, 0x1000, 0x0100
UNIT, TICKS, KEY_EVERY = 16 * BLOCK, CLOCK // 25, 8

DEMUXED = "struct<payload binary, program int, pmt_pid int, stream_pid int, continuity_errors int, units array<struct<pts bigint, random_access boolean, position int, length int>>>"
_DEMUXED = pa.struct(
    [
        ("payload", pa.binary()), ("program", pa.int32()), ("pmt_pid", pa.int32()), ("stream_pid", pa.int32()), ("continuity_errors", pa.int32()),
        ("units", pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("position", pa.int32()), ("length", pa.int32())]))),
    ]
)


@lru_cache(maxsize=256)
def table_crc(section: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    section = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    section += struct.pack(">I", table_crc(section))
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _table_packet(PAT_PID, 0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _table_packet(PMT_PID, 0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_PES, 0xE000 | STREAM_PID, 0xF000))
    return pat + pmt


def _time_stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | pts >> 29 & 0x0E, pts >> 14 & 0xFFFE | 1, pts << 1 & 0xFFFE | 1)


def padded(data: bytes) -> bytes:
    """The payload: the bytes, filled up to a positive multiple of BLOCK."""
    return data + bytes([FILL]) * (-len(data) % BLOCK or (0 if data else BLOCK))


def stream(payload: bytes) -> bytes:
    """The payload's transport stream."""
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x80, 0x80, 5) + _time_stamp(k * TICKS & (1 << 33) - 1) + unit
        key = 0x40 if k % KEY_EVERY == 0 else 0
        head = PACKET - 6  # after a header and a two-byte adaptation field
        full, rest = divmod(max(0, len(pes) - head), PACKET - 4)
        first = PACKET - 4 - min(len(pes), head)  # bytes of the adaptation field
        out.append(struct.pack(">BHBBB", SYNC, 0x4000 | STREAM_PID, 0x30 | counter & 15, first - 1, key) + b"\xff" * (first - 2) + pes[:head])
        if full:
            body = np.empty((full, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
            body[:, 3] = 0x10 | (counter + 1 + np.arange(full)) & 15
            body[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), head).reshape(full, -1)
            out.append(body.tobytes())
        counter += 1 + full
        if rest:
            spare = PACKET - 4 - rest
            field = bytes([spare - 1]) + (b"\0" + b"\xff" * (spare - 2) if spare > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, STREAM_PID, 0x30 | counter & 15) + field + pes[-rest:])
            counter += 1
    return b"".join(out)


def _section(packets: np.ndarray, pids: np.ndarray, pid: int, table: int) -> bytes:
    """The body of the first table on a PID, its CRC checked."""
    found = np.flatnonzero(pids == pid)
    if not len(found):
        raise ValueError(f"no table on PID {pid}")
    raw = packets[found[0]].tobytes()[4:]
    raw = raw[1 + raw[0] :]
    section = raw[: 3 + (struct.unpack(">H", raw[1:3])[0] & 0xFFF)]
    if section[0] != table or table_crc(section[:-4]) != struct.unpack(">I", section[-4:])[0]:
        raise ValueError(f"damaged table on PID {pid}")
    return section[8:-4]


def read_stream(media: bytes) -> dict:
    """What demux() returns for one stream."""
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    program, pmt_pid = struct.unpack(">HH", _section(packets, pids, PAT_PID, 0x00)[:4])
    pmt_pid &= 0x1FFF
    pmt = _section(packets, pids, pmt_pid, 0x02)
    skip = 4 + (struct.unpack(">H", pmt[2:4])[0] & 0xFFF)
    stream_pid = struct.unpack(">H", pmt[skip + 1 : skip + 3])[0] & 0x1FFF
    own = packets[pids == stream_pid]
    control, counters = own[:, 3] >> 4 & 3, own[:, 3] & 15
    with_payload = (control & 1).astype(bool)
    steps = np.diff(counters[with_payload].astype(np.int16)) % 16
    begin = 4 + np.where(control & 2, own[:, 4].astype(np.int32) + 1, 0)
    begin[~with_payload] = PACKET
    keys = (control & 2).astype(bool) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    parts, units, position = [], [], 0
    for n, at in enumerate(starts):
        a = int(ends[at] - (PACKET - begin[at]))
        b = int(ends[starts[n + 1] - 1]) if n + 1 < len(starts) else len(data)
        pes = data[a:b]
        if pes[:3] != b"\0\0\1":
            raise ValueError("no PES start code")
        unit = pes[9 + pes[8] : 6 + struct.unpack(">H", pes[4:6])[0]]
        t = pes[9:14] if pes[7] & 0x80 else None
        pts = None if t is None else (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
        units.append({"pts": pts, "random_access": bool(keys[at]), "position": position, "length": len(unit)})
        parts.append(unit)
        position += len(unit)
    return {"payload": b"".join(parts), "program": program, "pmt_pid": pmt_pid, "stream_pid": stream_pid, "continuity_errors": int((steps != 1).sum()), "units": units}


def _by_slices(batch: pa.Array, f: Callable, kind: pa.DataType, rows: int = 128) -> pa.Array:
    """f of each value; only a slice's values are Python objects at a time."""
    made = [pa.array([f(x) for x in batch.slice(a, rows).to_pylist()], kind) for a in range(0, len(batch), rows)]
    return pa.concat_arrays(made or [pa.array([], kind)])


def mux(data: Column) -> Column:
    """binary: the transport stream of a binary column."""

    @arrow_udf("binary")
    def streams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _by_slices(batch, lambda x: stream(padded(x or b"")), pa.binary())

    return streams(data)


def demux(media: Column) -> Column:
    """The struct DEMUXED of a column of transport streams; null for null."""

    @arrow_udf(DEMUXED)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _by_slices(batch, lambda x: None if x is None else read_stream(x), _DEMUXED)

    return read(media)


def feature(demuxed: Column) -> Column:
    """A line of text about a stream: program, PIDs, units, first and last time stamp, random-access points, continuity errors."""
    units = demuxed["units"]
    return F.format_string(
        "program=%d pmt=%d pid=%d units=%d pts=%d-%d keys=%d lost=%d",
        demuxed["program"], demuxed["pmt_pid"], demuxed["stream_pid"], F.size(units), units[0]["pts"], F.element_at(units, -1)["pts"],
        F.size(F.filter(units, lambda u: u["random_access"])), demuxed["continuity_errors"],
    )
