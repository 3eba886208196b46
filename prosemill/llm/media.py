"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

mux writes a payload as one program: program tables, then elementary packets (PES) cut into 188-byte packets, each access
unit with a timestamp, its first packet marked as a random-access point and carrying the clock. demux is a reader of its
own: it finds the stream through the tables, checks sections and continuity counters, reassembles the elementary packets
and lists their timestamps. Both work on whole arrays of packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers

#: Fixed values of the standard: packet size, sync byte, table ids, the private-data stream's type and id, clock rate.
PACKET, SYNC, PAT_PID, PAT_TABLE, PMT_TABLE, PRIVATE_TYPE, PRIVATE_ID, CLOCK = 188, 0x47, 0, 0x00, 0x02, 0x06, 0xBD, 90_000
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Payload bytes of an access unit, and 8-bit samples a second, which give its timestamp.
UNIT, RATE = 32_768, 8_000


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, which ends each table section."""
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    whole = head + body
    return whole + crc32_mpeg(whole).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10" + b"\x00"
    return (head + section).ljust(PACKET, b"\xff")


@cache
def tables() -> bytes:
    pat = _section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _timestamp(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """A transport stream of payload, a sample a byte. An empty payload gives a stream of tables alone."""
    out, counter = [tables()], 0
    for at in range(0, len(payload), unit):
        body, time = payload[at : at + unit], at * CLOCK // rate
        optional = b"\x80\x80\x05" + _timestamp(time)
        length = len(body) + len(optional)
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (length if length < 65536 else 0).to_bytes(2, "big") + optional + body
        # First packet: random access and clock (7 bytes of adaptation after its length), then 176 bytes or stuffing.
        base = time & ((1 << 33) - 1)
        clock = ((base << 15) | 0x7E00).to_bytes(6, "big")
        first = pes[:176]
        field_len = 7 + 176 - len(first)
        out.append(bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | counter, field_len, 0x50]) + clock + b"\xff" * (176 - len(first)) + first)
        counter = (counter + 1) & 15
        rest = pes[176:]
        full = len(rest) // 184
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            packets[:, 3] = 0x10 | ((counter + np.arange(full)) & 15)
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * 184).reshape(full, 184)
            out.append(packets.tobytes())
            counter = (counter + full) & 15
        if tail := rest[full * 184 :]:
            stuffing = 183 - len(tail)
            adaptation = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC]) + DATA_PID.to_bytes(2, "big") + bytes([0x30 | counter]) + adaptation + tail)
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: its timestamp, the number of the packet in which it begins, and whether that is a random-access
    point."""

    time: int | None
    packet: int
    access: bool


@dataclass
class Stream:
    """What demux found."""

    payload: bytes = b""
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    lost: int = 0  # packets after which the continuity counter doesn't fit
    repeated: int = 0  # packets that were sent twice, as the standard permits, and count once
    bad_tables: int = 0
    error: str = ""

    @property
    def times(self) -> list[int]:
        return [u.time for u in self.units if u.time is not None]

    @property
    def random_access(self) -> list[int]:
        return [u.packet for u in self.units if u.access]


def _pids(packets: np.ndarray) -> np.ndarray:
    return ((packets[:, 1].astype(np.int32) & 0x1F) << 8) | packets[:, 2]


def _sections(packets: np.ndarray, pid: int, table_id: int) -> tuple[list[bytes], int]:
    """Bodies of the sound sections of a pid, over as many packets as they take, and the number of others."""
    found, bad, held, before = [], 0, None, b""

    def take(whole: bytes) -> bytes:
        """Takes the sections at the start, and returns what is left of one that isn't complete."""
        nonlocal bad
        while whole and whole[0] != 0xFF:
            size = ((whole[1] & 0x0F) << 8 | whole[2]) + 3 if len(whole) >= 3 else 3
            if len(whole) < size:
                return whole
            section, whole = whole[:size], whole[size:]
            if size < 12 or section[0] != table_id or crc32_mpeg(section):
                bad += 1
            else:
                found.append(section[8:-4])
        return b""

    for row in packets[(_pids(packets) == pid) & ((packets[:, 3] & 0x10) > 0)]:
        raw = row.tobytes()
        if raw == before:
            continue
        before, at = raw, 4 + (raw[4] + 1 if raw[3] & 0x20 else 0)
        body = raw[at:]
        if raw[1] & 0x40 and body:
            first = 1 + body[0]
            if held is not None:
                bad += bool(take(held + body[1:first]))
            held = take(body[first:])
        elif held:
            held = take(held + body)
    return found, bad + bool(held)


def demux(data: bytes) -> Stream:
    """Reads a transport stream; never raises on bad data, which it counts or names in error."""
    out = Stream()
    if not data or len(data) % PACKET:
        out.error = "not whole packets"
        return out
    packets = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    out.packets = len(packets)
    if (packets[:, 0] != SYNC).any():
        out.error = "sync lost"
        return out
    pat, bad = _sections(packets, PAT_PID, PAT_TABLE)
    out.bad_tables += bad
    programs = {int.from_bytes(p[i : i + 2], "big"): int.from_bytes(p[i + 2 : i + 4], "big") & 0x1FFF for p in pat for i in range(0, len(p) - 3, 4)}
    programs.pop(0, None)
    if not programs:
        out.error = "no program"
        return out
    pmt, bad = _sections(packets, programs[min(programs)], PMT_TABLE)
    out.bad_tables += bad
    streams = []
    for p in pmt:
        at = 4 + (int.from_bytes(p[2:4], "big") & 0x0FFF)
        while at + 5 <= len(p):
            streams.append((p[at], int.from_bytes(p[at + 1 : at + 3], "big") & 0x1FFF))
            at += 5 + (int.from_bytes(p[at + 3 : at + 5], "big") & 0x0FFF)
    if not (pids := [pid for kind, pid in streams if kind == PRIVATE_TYPE]):
        out.error = "no data stream"
        return out
    numbers = np.flatnonzero((_pids(packets) == pids[0]) & ((packets[:, 3] & 0x10) > 0))
    own = packets[numbers]
    steps = (own[1:, 3].astype(np.int32) - own[:-1, 3]) & 15
    twice = [i + 1 for i in np.flatnonzero(steps == 0) if _same(own[i], own[i + 1])]
    if twice:
        out.repeated, keep = len(twice), np.ones(len(own), bool)
        keep[twice] = False
        own, numbers = own[keep], numbers[keep]
        steps = (own[1:, 3].astype(np.int32) - own[:-1, 3]) & 15
    adapted = (own[:, 3] & 0x20) > 0
    start = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    out.lost = int(((steps != 1) & ((flags[1:] & 0x80) == 0)).sum())  # a counter may jump where the stream says so
    body = own[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
    sizes = np.maximum(0, PACKET - start)
    heads = np.flatnonzero((own[:, 1] & 0x40) > 0)
    begins, access = (np.cumsum(sizes) - sizes)[heads].tolist(), (flags[heads] & 0x40) > 0
    parts = []
    for a, b, number, point in zip(begins, [*begins[1:], len(body)], numbers[heads].tolist(), access.tolist()):
        pes = body[a:b]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.error = "no elementary packet"
            continue
        length, time = int.from_bytes(pes[4:6], "big"), None
        if pes[7] & 0x80 and len(pes) >= 14:
            t = pes[9:14]
            time = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
        out.units.append(Unit(time, number, point))
        part = pes[9 + pes[8] : 6 + length if length else None]
        if length and len(pes) < 6 + length:
            out.error = "elementary packet cut short"
        parts.append(part)
    out.payload = b"".join(parts)
    return out


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a packet is sent twice: all bytes are equal but those of a clock, which may be another."""
    equal = a == b
    if a[3] & 0x20 and a[4] >= 7 and a[5] & 0x10:
        equal[6:12] = True
    return bool(equal.all())


def add_streams(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """docs with media, the whole text's UTF-8 as a transport stream, zero bytes up to a positive multiple of 64, and n_bytes
    without these. A null text is an empty one, of 64 zero bytes. Columns of those names are replaced, others stay."""
    workers(docs.sparkSession)

    @F.pandas_udf("media binary, n_bytes long")
    def made(texts: pd.Series) -> pd.DataFrame:
        raw = [(t or "").encode() for t in texts]
        return pd.DataFrame({"media": [mux(padded(r)) for r in raw], "n_bytes": [len(r) for r in raw]})

    return docs.withColumn("__made", made(F.col(text))).withColumn(media, F.col("__made.media")).withColumn(n_bytes, F.col("__made.n_bytes")).drop("__made")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, access_packets array<long>"


def stream_features(media: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """keys and FEATURES, read back from the stored streams: digests of the payload and the stored form, and a line on its
    structure: packets, elementary packets, random-access points, first and last timestamp, faults, mean and deviation of the
    samples; and the timestamps and random-access points themselves, each of an elementary packet. A null or broken stream has
    an empty payload and says so in the line."""
    workers(media.sparkSession)
    schema = ", ".join(f"`{k}` {media.schema[k].dataType.simpleString()}" for k in keys)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch[column]:
                raw = bytes(raw) if raw is not None else b""
                s = demux(raw)
                samples = np.frombuffer(s.payload, np.uint8)
                line = f"packets={s.packets};units={len(s.times)};random={len(s.random_access)};first={s.times[0] if s.times else -1};last={s.times[-1] if s.times else -1};lost={s.lost};bad={s.bad_tables};mean={samples.mean() if len(samples) else 0:.4f};sd={samples.std() if len(samples) else 0:.4f};error={s.error}"
                out.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), line, s.times, s.random_access))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])
            yield pd.concat([batch[keys].reset_index(drop=True), made], axis=1)

    return media.select(*keys, column).mapInPandas(read, f"{schema}, {FEATURES}")


def stream_index(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """A row for each elementary packet: (key, unit, time, packet, random_access): its 90 kHz timestamp, null without one, the
    packet in which it begins, and whether a reader may start there. A key of one of those names is called by it and _.
    Null and broken streams have no rows; null and repeated keys stay."""
    workers(media.sparkSession)
    names = ["unit", "time", "packet", "random_access"]
    shown = key + "_" if key in names else key

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, u.time, u.packet, u.access) for k, raw in zip(batch["__key"].astype(object).where(batch["__key"].notna(), None), batch["__media"]) for i, u in enumerate(demux(bytes(raw) if raw is not None else b"").units)]
            made = pd.DataFrame(out, columns=[shown, *names], dtype=object)
            yield made.astype({"unit": "Int64", "time": "Int64", "packet": "Int64", "random_access": "boolean"})

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{column}`").alias("__media")).mapInPandas(read, f"`{shown}` {kind}, unit long, time long, packet long, random_access boolean")
