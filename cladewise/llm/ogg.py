"""Ogg media columns: write and read physical bitstreams held in a binary column.

Reading verifies each page's checksum, puts packets together from lacing
values (also across pages), separates logical streams by serial number and
dates packets by granule position. All of it follows RFC 3533: a page's granule
position belongs to the last packet that ends on it. Packets that end before it
on the page are dated by counting back the durations of those after them, which
is possible where the stream's codec tells durations; else they have no date.
There is no audio codec: the sample stream carries unsigned 8-bit samples as
they are, so a packet lasts as many samples as it has bytes. Other streams,
such as notes, have a date for the last packet of each page only.

Defined results: a null medium gives null; bytes that are not an Ogg page are
skipped up to the next capture pattern and counted; a page whose checksum is
wrong is left out, counted, and breaks the packet it belongs to; an empty
medium has no streams. Equal media give equal rows.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
#: A granule position that says that no packet ends on the page.
NONE = (1 << 64) - 1
RATE = 8000
SAMPLES = 4096
HEADER = struct.Struct("<4sBBQIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, from 0: zlib's, on mirrored bytes and mirrored back."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def pages(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) for packets (bytes, granule). The first packet has a page of its own."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, flags, fresh = bytearray(), bytearray(), NONE, FIRST, True

    def flush(end: bool, going: bool) -> None:
        nonlocal lacing, body, granule, flags, fresh
        out.append((granule, _page(flags | LAST * end, granule, serial, len(out), bytes(lacing), bytes(body))))
        lacing, body, granule, flags = bytearray(), bytearray(), NONE, CONTINUED * going

    for i, (packet, at) in enumerate(packets):
        whole, rest = divmod(len(packet), 255)
        left = memoryview(packet)
        for k in range(whole + 1):
            n = 255 if k < whole else rest
            if len(lacing) == 255:
                flush(False, k > 0)
            lacing.append(n)
            body += left[:n]
            left = left[n:]
        granule = at
        if i == 0 or i == len(packets) - 1:
            flush(i == len(packets) - 1, False)
    return out


def encode(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """Two logical streams: samples, and notes with the length before padding. Pages stand in order of time."""
    crc = zlib.crc32(payload)
    sound = [(struct.pack("<8sBBI", b"PCMU8   ", 1, 1, rate), 0)]
    sound += [(payload[i : i + SAMPLES], min(i + SAMPLES, len(payload))) for i in range(0, len(payload), SAMPLES)]
    notes = [(b"NOTES   ", 0), (struct.pack("<QI", n_bytes, crc), len(payload))]
    a, b = pages(sound, crc & 0x7FFFFFFF), pages(notes, crc & 0x7FFFFFFF | 0x80000000)
    key = lambda p: -1 if p[0] == NONE else p[0]
    body = sorted([(key(p), 0, i, p[1]) for i, p in enumerate(a[1:])] + [(key(p), 1, i, p[1]) for i, p in enumerate(b[1:])])
    # A page on which no packet ends must not overtake the one before it.
    if any(p[0] == NONE for p in a + b):
        body = [(0, 0, i, p[1]) for i, p in enumerate(a[1:])] + [(0, 1, i, p[1]) for i, p in enumerate(b[1:])]
    return b"".join([a[0][1], b[0][1], *(x[3] for x in body)])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[tuple[int, int]] = field(default_factory=list)  # for each page on which packets end: number of packets so far, granule
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _part: bytearray | None = None
    _next: int = 0


@dataclass
class Medium:
    streams: dict[int, Stream] = field(default_factory=dict)
    bad_pages: int = 0
    skipped: int = 0


def demultiplex(data: bytes) -> Medium:
    out, at = Medium(), 0
    while at < len(data):
        found = data.find(CAPTURE, at)
        if found < 0:
            out.skipped += len(data) - at
            break
        out.skipped += found - at
        at = found
        if at + 27 > len(data):
            out.skipped += len(data) - at
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            out.bad_pages += 1
            at += 4
            out.skipped += 4
            continue
        s = out.streams.setdefault(serial, Stream(serial))
        if number != s._next or (flags & CONTINUED == 0 and s._part is not None):
            s.lost += s._part is not None
            s._part = None
        s._next, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        skip = bool(flags & CONTINUED) and s._part is None  # the tail of a packet whose head is lost
        s.lost += skip
        part = s._part if s._part is not None else bytearray()
        pos, open_ = at + 27 + n, s._part is not None
        for size in lacing:
            part += data[pos : pos + size]
            pos += size
            open_ = size == 255
            if not open_:
                if skip:
                    skip = False
                else:
                    s.packets.append(bytes(part))
                part = bytearray()
        s._part = part if open_ and not skip else None
        if granule != NONE and len(s.packets) > (s.ends[-1][0] if s.ends else 0):
            s.ends.append((len(s.packets), granule))
        at = end
    return out


def granules(s: Stream, duration=None) -> list[int | None]:
    """The granule position at which each packet ends. duration: samples of a packet, if the codec tells."""
    out: list[int | None] = [None] * len(s.packets)
    first = 0
    for end, granule in s.ends:
        out[end - 1] = granule
        if duration is not None:
            for i in range(end - 2, first - 1, -1):
                out[i] = out[i + 1] - duration(s.packets[i + 1])
        first = end
    return out


PACKETS = "array<struct<serial:long,packet:int,granule:long,micros:long,body:binary>>"
SUMMARY = "struct<streams:int,pages:int,bad_pages:int,skipped:long,lost:int,ended:boolean,rate:int,n_bytes:long,packets:int,micros:long,payload:binary>"
FIELDS = ["streams", "pages", "bad_pages", "skipped", "lost", "ended", "rate", "n_bytes", "packets", "micros", "payload"]


def _samples(s: Stream) -> int | None:
    """The rate of a stream of samples, None for another."""
    head = s.packets[0] if s.packets else b""
    return struct.unpack("<8sBBI", head)[3] if head.startswith(b"PCMU8   ") and len(head) == 14 else None


def _dated(medium: Medium) -> list[dict]:
    """All packets, by serial number and order, with their times."""
    streams = sorted(medium.streams.values(), key=lambda s: s.serial)
    rate = next((r for r in map(_samples, streams) if r), None)
    out = []
    for s in streams:
        at = granules(s, len if _samples(s) else None)
        if _samples(s):
            at[0] = 0  # the header takes no time
        out += [{"serial": s.serial, "packet": i, "granule": g, "micros": None if g is None or not rate else g * 1_000_000 // rate, "body": b} for i, (b, g) in enumerate(zip(s.packets, at, strict=True))]
    return out


def _read(data: bytes | None) -> dict | None:
    if data is None:
        return None
    medium = demultiplex(data)
    rate, n_bytes, payload = None, None, []
    for s in sorted(medium.streams.values(), key=lambda s: s.serial):
        head = s.packets[0] if s.packets else b""
        if _samples(s) is not None:
            rate = _samples(s)
            payload += s.packets[1:]
        elif head.startswith(b"NOTES   ") and len(s.packets) > 1 and len(s.packets[1]) == 12:
            n_bytes = struct.unpack("<QI", s.packets[1])[0]
    every = medium.streams.values()
    times = [p["micros"] for p in _dated(medium) if p["micros"] is not None]
    return {"streams": len(every), "pages": sum(s.pages for s in every), "bad_pages": medium.bad_pages, "skipped": medium.skipped, "lost": sum(s.lost + (s._part is not None) for s in every), "ended": all(s.ended for s in every), "rate": rate, "n_bytes": n_bytes, "packets": sum(len(s.packets) for s in every), "micros": max(times, default=None), "payload": b"".join(payload)}


def _texts_to_media(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> bytes:
        raw = (text or "").encode()
        return encode(raw + bytes(-len(raw) % 64 if raw else 64), len(raw))

    return texts.map(one, na_action=None)


def _media_to_summaries(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(x) or dict.fromkeys(FIELDS) for x in media], columns=FIELDS, dtype=object)


def _media_to_packets(media: pd.Series) -> pd.Series:
    return media.map(lambda x: None if x is None else _dated(demultiplex(x)), na_action=None)


def ogg_from_text(texts: Column) -> Column:
    """The text's UTF-8 bytes as samples, padded with 0 to a positive multiple of 64. Null counts as empty."""
    return F.pandas_udf(_texts_to_media, "binary")(texts)


def read_ogg(media: Column) -> Column:
    """What a medium holds: counts, sample rate, the time at which its last dated packet ends, and the payload put together again."""
    return F.pandas_udf(_media_to_summaries, SUMMARY)(media)


def ogg_packets(df: DataFrame, media_col: str, *keep: str) -> DataFrame:
    """A row for each packet of each logical stream, with the granule position and the time at which it ends."""
    return df.select(*keep, F.inline(F.pandas_udf(_media_to_packets, PACKETS)(F.col(media_col))))


def op2_ogg_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = docs.select("doc_id", ogg_from_text(F.col("text").cast("string")).alias("media")).withColumn("m", read_ogg(F.col("media")))
    p = F.col("m.payload")
    return read.select(
        "doc_id",
        "m.n_bytes",
        F.length(p).cast("long").alias("payload_bytes"),
        F.sha2(p, 256).alias("payload_sha256"),
        F.crc32(F.substring(p, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("streams=%d pages=%d packets=%d bad=%d lost=%d micros=%d", "m.streams", "m.pages", "m.packets", "m.bad_pages", "m.lost", "m.micros").alias("feature"),
    )
