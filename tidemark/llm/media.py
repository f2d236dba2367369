"""Media columns: MPEG transport streams.

A text's bytes are a track of 8-bit samples (8000 a second), carried as private PES
data: packets of 188 bytes with program tables, continuity counters and clock
references. The reader works on any transport stream: it finds the program map through
the program association table, checks continuity counters per PID, reassembles
elementary packets and returns their time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, BODY = 188, 184
PMT_PID, TRACK_PID, STREAM_TYPE = 0x100, 0x101, 0x06
RATE, CLOCK = 8000, 90000
#: Samples in one PES packet, and PES packets from one random-access point to the next.
PES_SAMPLES, RANDOM_ACCESS_EVERY = 8000, 4
BLOCK = 64


@cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables."""
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


@cache
def _tables() -> bytes:
    """The packets of a program association table and a program map table."""
    out = b""
    for pid, body in (
        (0, bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])),
        (PMT_PID, bytes([2, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | TRACK_PID >> 8, TRACK_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | TRACK_PID >> 8, TRACK_PID & 255, 0xF0, 0])),
    ):
        section = b"\0" + body + crc32_mpeg(body).to_bytes(4, "big")
        out += bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + section.ljust(BODY, b"\xff")
    return out


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def mux(payload: bytes) -> bytes:
    """A payload as a transport stream of one program with one track."""
    out, count = [_tables()], 0
    for i, at in enumerate(range(0, max(1, len(payload)), PES_SAMPLES)):
        data = payload[at : at + PES_SAMPLES]
        pts = at * CLOCK // RATE & (1 << 33) - 1
        pes = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + _pts_bytes(pts) + data
        # the first packet has the clock reference and the random-access flag
        pcr = (pts << 15 | 0x7E00).to_bytes(6, "big")
        flags = 0x10 | (0x40 if i % RANDOM_ACCESS_EVERY == 0 else 0)
        first, rest = pes[: BODY - 8], pes[BODY - 8 :]
        stuffing = BODY - 8 - len(first)
        out.append(bytes([0x47, 0x40 | TRACK_PID >> 8, TRACK_PID & 255, 0x30 | count & 15, 7 + stuffing, flags]) + pcr + b"\xff" * stuffing + first)
        count += 1
        full = len(rest) // BODY
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, TRACK_PID >> 8, TRACK_PID & 255
            block[:, 3] = 0x10 | (count + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(rest[: full * BODY], np.uint8).reshape(full, BODY)
            out.append(block.tobytes())
            count += full
        if tail := rest[full * BODY :]:
            pad = BODY - len(tail)
            field_ = b"" if not pad else bytes([pad - 1]) + (b"\0" + b"\xff" * (pad - 2) if pad > 1 else b"")
            out.append(bytes([0x47, TRACK_PID >> 8, TRACK_PID & 255, (0x30 if pad else 0x10) | count & 15]) + field_ + tail)
            count += 1
    return b"".join(out)


@dataclass
class Track:
    """One elementary stream: its bytes, and each PES packet's start, size, time stamp
    (None without one) and whether it is a random-access point."""

    pid: int
    stream_type: int
    data: bytes = b""
    starts: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    stamps: list[int | None] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    continuity_errors: int = 0


def _section(packets: np.ndarray, offsets: np.ndarray, pid: int, pids: np.ndarray) -> bytes | None:
    """The first whole section on a PID, None if there is none or its CRC is wrong."""
    data, started = b"", False
    for i in np.flatnonzero(pids == pid):
        body = packets[i, offsets[i] :].tobytes()
        if packets[i, 1] & 0x40 and body:
            if started:
                break
            body, started = body[1 + body[0] :], True
        if started:
            data += body
        if len(data) >= 3 and len(data) >= 3 + (int.from_bytes(data[1:3], "big") & 0xFFF):
            data = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
            return data if crc32_mpeg(data) == 0 else None
    return None


def demux(stream: bytes) -> list[Track]:
    """The tracks of a transport stream's programs. Packets without the sync byte, with
    the error flag or without payload are passed over; a repeated packet (the same
    counter and body) counts once; any other jump of a counter is a continuity error."""
    n = len(stream) // PACKET
    p = np.frombuffer(stream[: n * PACKET], np.uint8).reshape(n, PACKET)
    p = p[(p[:, 0] == 0x47) & (p[:, 1] & 0x80 == 0)]
    pids = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    offsets = np.where(control & 2, 5 + p[:, 4].astype(np.int64), 4)
    offsets = np.where((control & 1) & (offsets < PACKET), offsets, PACKET)
    tracks: list[Track] = []
    pat = _section(p, offsets, 0, pids)
    for at in range(8, len(pat) - 4 if pat else 0, 4):
        number, pid = int.from_bytes(pat[at : at + 2], "big"), int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
        pmt = _section(p, offsets, pid, pids) if number else None
        if pmt:
            i = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
            while i + 5 <= len(pmt) - 4:
                tracks.append(Track(int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF, pmt[i]))
                i += 5 + (int.from_bytes(pmt[i + 3 : i + 5], "big") & 0xFFF)
    for t in tracks:
        _reassemble(t, p, np.flatnonzero((pids == t.pid) & (offsets < PACKET)), offsets)
    return tracks


def _reassemble(t: Track, p: np.ndarray, own: np.ndarray, offsets: np.ndarray) -> None:
    counts = (p[own, 3] & 15).astype(np.int64)
    if len(own) > 1:
        same = (np.diff(counts) == 0) & (p[own[1:], 4:] == p[own[:-1], 4:]).all(axis=1)
        own, counts = own[np.r_[True, ~same]], counts[np.r_[True, ~same]]
        t.continuity_errors = int((np.diff(counts) % 16 != 1).sum())
    starts = np.flatnonzero(p[own, 1] & 0x40)
    out = []
    for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
        part = own[a:b]
        if (offsets[part[1:]] == 4).all():
            body = p[part[0], offsets[part[0]] :].tobytes() + p[part[1:], 4:].tobytes()
        else:
            body = b"".join(p[i, offsets[i] :].tobytes() for i in part)
        if body[:3] != b"\0\0\1" or len(body) < 9:
            continue
        size = int.from_bytes(body[4:6], "big")
        stamp = None
        if body[7] & 0x80 and len(body) >= 14:
            x = body[9:14]
            stamp = (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1
        data = body[9 + body[8] : 6 + size if size else len(body)]
        first = p[part[0]]
        t.starts.append(sum(t.sizes[-1:]) + (t.starts[-1] if t.starts else 0))
        t.sizes.append(len(data))
        t.stamps.append(stamp)
        t.random_access.append(bool(first[3] & 0x20 and first[4] and first[5] & 0x40))
        out.append(data)
    t.data = b"".join(out)


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 bytes, and them with zeros to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def encoded(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media: every whole text as a stream of its
    own (null text: as the empty one, a single block of zeros)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(d) for _, d in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_TRACKS = "array<struct<pid:int,stream_type:int,payload:binary,stamps:array<long>,starts:array<long>,sizes:array<long>,random_access:array<boolean>,continuity_errors:int>>"


def decoded(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> doc_id, n_bytes, media_bytes, media_sha256,
    tracks: what demux finds. A stream that has no program map has no tracks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pid", pa.int32()), ("stream_type", pa.int32()), ("payload", pa.binary()), ("stamps", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("random_access", pa.list_(pa.bool_())), ("continuity_errors", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                streams = [m or b"" for m in part.column(2).to_pylist()]
                tracks = [[{"pid": t.pid, "stream_type": t.stream_type, "payload": t.data, "stamps": t.stamps, "starts": t.starts, "sizes": t.sizes, "random_access": t.random_access, "continuity_errors": t.continuity_errors} for t in demux(m)] for m in streams]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(m) for m in streams], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in streams]), pa.array(tracks, kind)],
                    names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "tracks"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, tracks {_TRACKS}")


def digest(found: DataFrame) -> DataFrame:
    """decoded rows -> the digest columns of each row's payload, and its feature: PID,
    stream type, PES packets, random-access points, first and last time stamp,
    continuity errors of every track."""
    data = F.expr("aggregate(tracks, cast('' as binary), (a, t) -> concat(a, t.payload))")
    feature = F.expr("""concat_ws(';', transform(tracks, t -> concat_ws(',',
        concat('pid=', t.pid), concat('type=', t.stream_type), concat('pes=', size(t.starts)),
        concat('rap=', size(filter(t.random_access, x -> x))),
        concat('pts=', array_min(t.stamps), '-', array_max(t.stamps)), concat('cc=', t.continuity_errors))))""")
    out = found.withColumn("__data", data)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("__data").cast("long").alias("payload_bytes"),
        F.sha2("__data", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(__data, -{BLOCK}, {BLOCK})")).cast("long").alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
