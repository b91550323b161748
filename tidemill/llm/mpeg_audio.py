"""MPEG audio columns: payloads stored in MPEG-1 layer III frames, and a reader of MPEG audio.

The stored form is an ID3v2.4 tag, a Xing frame (frame count, byte count, 100
seek points) and frames of 32 kHz mono. A frame carries at most 960 payload
bytes as its two granules' main data, the side information holds their lengths,
and the header's CRC-16 covers header and side information. The last frame takes
the lowest bit rate that holds it.

The reader takes MPEG-1, 2 and 2.5, layers I to III. It reads ID3v2.2 to 2.4 tags in their four encodings, unsynchronised
or not, ID3v1 and APE tags at the end, resynchronises on
frame headers (a header counts when its checksum holds and another header of its kind, a tag
or the end follows), parses the variable-bitrate tables (Xing or Info with its seek points and the encoder's delay and
padding, VBRI with its table), and gives exact duration and the frames' offsets. Checksums of layer II, whose extent depends on the
allocation, aren't verified. Payloads are read from mono MPEG-1 layer III, which is what the writer makes.

Texts: null counts as empty; a text's UTF-8 bytes are padded with zeros to a
positive multiple of 64. Very long texts are one file, held whole by its task. Repeated rows each get their row, equal texts equal
values; an empty table gives an empty one. Other columns of the input are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R

#: Fixed values of MPEG-1 layer III: kbit/s by bit-rate index, Hz by rate index, samples in a frame.
KBITS = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
HERTZ = [44100, 48000, 32000]
SAMPLES = 1152
#: Fixed values of the other versions and layers: kbit/s by (MPEG-1, layer) and bit-rate index.
RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): KBITS,
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
#: Hz are divided by this, by version bits; encodings by ID3's encoding byte.
DIVIDED = {3: 1, 2: 2, 0: 4}
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}

UNIT, MOST, SIDE = 64, 960, 17
HEAD = 4 + 2 + SIDE
RATE = 2


def frame_bytes(bitrate: int, rate: int, padding: int) -> int:
    return 144_000 * KBITS[bitrate] // HERTZ[rate] + padding


@lru_cache(maxsize=1 << 14)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, all ones at first, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        crc &= 0xFFFF
    return crc


@lru_cache(maxsize=64)
def frame_start(n: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame with n payload bytes; zeros that follow the payload."""
    bitrate = next(i for i in range(1, 15) if frame_bytes(i, RATE, 0) >= HEAD + n)
    head = bytes([0xFF, 0xFA, bitrate << 4 | RATE << 2, 0xC0])
    bits = 0
    for granule in range(2):  # 18 bits before the granules, 59 in each; a granule begins with its length in bits
        bits |= (n // 2 * 8) << (59 * (2 - granule) - 12)
    side = bits.to_bytes(SIDE, "big")
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, frame_bytes(bitrate, RATE, 0) - HEAD - n


def syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    sizes = [MOST] * (len(payload) // MOST) + ([len(payload) % MOST] if len(payload) % MOST else [])
    body = bytearray()
    at = 0
    starts = []
    first_len = frame_bytes(5, RATE, 0)
    for n in sizes:
        head, rest = frame_start(n)
        starts.append(first_len + len(body))
        body += head
        body += payload[at : at + n]
        body += bytes(rest)
        at += n
    total = first_len + len(body)
    head = bytes([0xFF, 0xFA, 5 << 4 | RATE << 2, 0xC0])
    side = bytes(SIDE)
    seek = bytes(min(255, starts[min(len(starts) - 1, len(starts) * p // 100)] * 256 // total) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(sizes), total) + seek
    first = head + crc16(head[2:] + side).to_bytes(2, "big") + side + xing
    text = b"\x03" + str(len(sizes) * SAMPLES * 1000 // HERTZ[RATE]).encode()
    tag = b"TLEN" + syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + first.ljust(first_len, b"\0") + bytes(body)


@dataclass
class Media:
    payload: bytes = b""
    frames: int = 0
    samples: dict[int, int] = field(default_factory=dict)  # by rate
    hertz: int = 0  # of the first frame
    version: float = 0
    layer: int = 0
    offsets: list[int] = field(default_factory=list)
    bitrates: dict[int, int] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    xing_frames: int | None = None
    xing_bytes: int | None = None
    seek: list[int] = field(default_factory=list)  # byte offsets from the first frame: of hundredths of the duration (Xing), of the table's steps (VBRI)
    delay: int = 0
    padding: int = 0
    skipped: int = 0
    bad: int = 0

    def microseconds(self) -> int:
        """Exact to the last sample; without what the encoder says that it has put before and after."""
        total = sum(Fraction(n, hertz) for hertz, n in self.samples.items())
        if self.hertz:
            total -= Fraction(min(self.delay + self.padding, self.samples.get(self.hertz, 0)), self.hertz)
        return int(total * 1_000_000)


@dataclass(frozen=True)
class Header:
    length: int
    kbits: int
    hertz: int
    samples: int
    version: int  # its two bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    mono: bool
    bound: int  # layer I: subbands with an allocation for each channel

    def like(self, other: "Header | None") -> bool:
        return other is not None and (self.version, self.layer, self.hertz) == (other.version, other.layer, other.hertz)

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        return (17 if self.mono else 32) if self.version == 3 else 9 if self.mono else 17


@lru_cache(maxsize=1 << 12)
def parsed_header(head: bytes) -> Header | None:
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    index, rate, pad = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbits, hertz = RATES[version == 3, layer][index], HERTZ[rate] // DIVIDED[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12_000 * kbits // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + pad
    mode = head[3] >> 6
    return Header(length, kbits, hertz, samples, version, layer, not head[1] & 1, mode == 3, 4 * ((head[3] >> 4 & 3) + 1) if mode == 1 else 32)


def header_at(data: bytes, at: int) -> Header | None:
    return parsed_header(data[at : at + 4])


def checksum_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether a frame's CRC-16 agrees with what it covers; frames without one, and layer II, pass."""
    if not h.protected or h.layer == 2:
        return True
    if h.layer == 3:
        covered, odd = data[at + 6 : at + 6 + h.side], 0
    else:  # layer I: four bits of allocation for each subband and channel
        bits = 128 if h.mono else 4 * (2 * h.bound + 32 - h.bound)
        covered, odd = data[at + 6 : at + 6 + bits // 8], bits % 8
    return not odd and crc16(data[at + 2 : at + 4] + covered) == int.from_bytes(data[at + 4 : at + 6], "big")


def number(data: bytes, shift: int) -> int:
    n = 0
    for b in data:
        n = n << shift | b
    return n


def tag_text(raw: bytes) -> str:
    return raw[1:].decode(ENCODINGS.get(raw[0], "latin-1"), "replace").rstrip("\0").lstrip("\ufeff") if raw else ""


def read_tags(data: bytes, media: Media) -> int:
    """Reads leading ID3v2 tags; where they end."""
    at = 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data) and max(data[at + 6 : at + 10]) < 128:
        version, flags, size = data[at + 3], data[at + 5], number(data[at + 6 : at + 10], 7)
        body = data[at + 10 : at + 10 + size]
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\x00", b"\xff")
        p = 0
        if flags & 0x40 and version > 2:  # an extended header, whose size counts itself in version 4 only
            p = number(body[:4], 7) if version == 4 else 4 + number(body[:4], 8)
        name, width = (3, 3) if version == 2 else (4, 4)
        while p + name + width <= len(body) and body[p : p + name].isalnum():
            key, n = body[p : p + name], number(body[p + name : p + name + width], 7 if version == 4 else 8)
            start = p + name + width + (0 if version == 2 else 2)
            raw = body[start : start + n]
            if version == 4 and start <= len(body) and body[start - 1] & 2:
                raw = raw.replace(b"\xff\x00", b"\xff")
            if key[:1] == b"T" and n:
                media.tags.setdefault(key.decode("latin-1"), tag_text(raw))
            p = start + n
        at += 10 + size + 10 * (version == 4 and bool(flags & 0x10))
    return min(at, len(data))


def read_end(data: bytes, media: Media) -> int:
    """Reads ID3v1 and APE tags at the end; where they begin."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, n in (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4)):
            if value := data[end + a : end + a + n].split(b"\0")[0].decode("latin-1").strip():
                media.tags.setdefault(key, value)
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count = (int.from_bytes(data[end - 20 + k : end - 16 + k], "little") for k in (0, 4))
        if 32 <= size <= end:
            p = end - size
            for _ in range(count):
                n, stop = int.from_bytes(data[p : p + 4], "little"), data.find(b"\0", p + 8, end - 32)
                if stop < 0 or stop + 1 + n > end - 32:
                    break
                media.tags.setdefault(data[p + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + n].decode("utf-8", "replace"))
                p = stop + 1 + n
            head = end - size - 32
            end -= size + 32 * (head >= 0 and data[head : head + 8] == b"APETAGEX")
    return end


def read_table(data: bytes, at: int, h: Header, media: Media) -> bool:
    """Reads a variable-bitrate table if the frame at `at` is one: Xing or Info behind the side information, VBRI behind 32 bytes."""
    p, whole = at + 4 + 2 * h.protected + h.side, at + h.length
    if h.layer == 3 and data[p : p + 4] in (b"Xing", b"Info"):
        flags = number(data[p + 4 : p + 8], 8)
        p += 8
        if flags & 1:
            media.xing_frames, p = number(data[p : p + 4], 8), p + 4
        if flags & 2:
            media.xing_bytes, p = number(data[p : p + 4], 8), p + 4
        if flags & 4:
            size = media.xing_bytes if media.xing_bytes is not None else len(data) - at
            media.seek, p = [x * size // 256 for x in data[p : p + 100]], p + 100
        p += 4 * bool(flags & 8)
        if p + 24 <= whole and data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            both = number(data[p + 21 : p + 24], 8)
            media.delay, media.padding = both >> 12, both & 0xFFF
        return True
    p = at + 36
    if h.layer == 3 and data[p : p + 4] == b"VBRI" and p + 26 <= whole:
        media.delay = number(data[p + 6 : p + 8], 8)
        media.xing_bytes, media.xing_frames = number(data[p + 10 : p + 14], 8), number(data[p + 14 : p + 18], 8)
        entries, scale, width = (number(data[p + k : p + k + 2], 8) for k in (18, 20, 22))
        seek, total = [0], 0
        for k in range(entries):
            total += number(data[p + 26 + k * width : p + 26 + (k + 1) * width], 8) * scale
            seek.append(total)
        media.seek = seek
        return True
    return False


def decode(data: bytes) -> Media:
    """Reads a file's frames, past damaged parts."""
    media, parts = Media(), []
    at, synced, kind = read_tags(data, media), False, None
    end = read_end(data, media)
    first = True
    while at < end:
        h = header_at(data, at)
        if h is not None and at + h.length <= end and (not synced or h.like(kind)):
            good = checksum_holds(data, at, h)
            if good and not synced:
                good = at + h.length >= end or h.like(header_at(data, at + h.length))
            if good:
                synced, kind = True, h
                if not (first and read_table(data, at, h, media)):
                    if not media.frames:
                        media.hertz, media.layer, media.version = h.hertz, h.layer, {3: 1, 2: 2, 0: 2.5}[h.version]
                    media.frames += 1
                    media.samples[h.hertz] = media.samples.get(h.hertz, 0) + h.samples
                    media.offsets.append(at)
                    media.bitrates[h.kbits] = media.bitrates.get(h.kbits, 0) + 1
                    if h.mono and h.layer == 3 and h.version == 3:
                        body = at + 4 + 2 * h.protected
                        bits, main = int.from_bytes(data[body : body + SIDE], "big"), body + SIDE
                        n = ((bits >> (59 * 2 - 12)) & 0xFFF) // 8 + ((bits >> (59 - 12)) & 0xFFF) // 8
                        parts.append(data[main : main + n])
                first = False
                at += h.length
                continue
            media.bad += synced
        synced = False
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        media.skipped += nxt - at
        at = nxt
    media.payload = b"".join(parts)
    return media


def padded(text: bytes) -> bytes:
    n = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text.ljust(n, b"\0")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (binary): every text as an MPEG audio file."""
    R.ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in R.pieces(batch, "t", 4 << 20):
                raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(padded(x)) for x in raw], pa.binary())], names=["i", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, n_bytes long, media binary").withColumnRenamed("i", id_col)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, duration_us long, hertz int, bitrates string, seek_offsets array<long>, bad_frames long, skipped_bytes long, seek_table array<long>"


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the reader finds in each file of `media_col`; seek_offsets has every frame's byte offset, seek_table the points of the file's own table. Null: an empty file."""
    kinds = dict(media.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in R.pieces(batch, "m", 4 << 20):
                cols: list[list] = [[] for _ in range(13)]
                for x in b.column(2).to_pylist():
                    x = x or b""
                    m = decode(x)
                    row = (
                        len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-64:]), len(x), hashlib.sha256(x).hexdigest(), m.frames,
                        m.microseconds(), m.hertz, ",".join(f"{k}x{n}" for k, n in sorted(m.bitrates.items())), np.array(m.offsets, np.int64), m.bad, m.skipped, np.array(m.seek, np.int64),
                    )
                    for c, v in zip(cols, row):
                        c.append(v)
                kind = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kind))], names=["i", "n_bytes", *(x.split()[0] for x in FEATURES.split(", "))])

    got = media.select(F.col(id_col).alias("i"), "n_bytes", F.col(media_col).alias("m")).mapInArrow(run, f"i {kinds[id_col]}, n_bytes long, {FEATURES}")
    return got.withColumnRenamed("i", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    offsets = F.col("seek_offsets")
    listed = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return got.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.format_string("frames=%d;us=%d;hz=%d;kbit=%s;first=%d;last=%d;bad=%d;offsets=%s;seek=%s", "frames", "duration_us", "hertz", "bitrates", offsets[0], F.element_at(offsets, -1), "bad_frames", listed("seek_offsets"), listed("seek_table")).alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_mpeg_audio": query}
