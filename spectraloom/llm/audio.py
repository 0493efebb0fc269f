"""Media columns: MPEG audio streams in binary columns, indexed frame by frame.

``index`` reads a stream: ID3v2 and ID3v1 tags, frame headers of MPEG 1, 2 and 2.5, layers I to
III, Xing / Info and VBRI tables, frame checksums (layer III over header and side information,
layer I over header and bit allocation), and gives the exact duration as a fraction of seconds
and the byte offset of every frame. After bytes that are no frame it resynchronises at the next
header that is followed by another frame of the same kind, by a tag, or by the end.

``store`` writes a payload as a variable-bitrate layer III stream: an ID3v2 tag that holds the
payload's length and CRC-32 and has a CRC of its own, a Xing frame with seek table, protected
frames with empty side information whose main data area carries the payload, and an ID3v1 tag.

Cases: null and empty streams have no frames and duration 0; free-format frames are not frames;
a stream cut within a frame ends before it; junk between frames is counted; a table that does not
fit into its frame is none; null texts count as empty; equal texts, rows that repeat among them, give
equal values; a very long payload takes as many frames as it needs; an empty table stays empty; columns
are found by place, so others whose names differ in case only do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import map_rows, pick, table

# Fixed values of the format: kbit/s by (version 1, layer), sampling rates by version.
BITRATES = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
TAG_KEY = "payload"


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int  # 3: one channel
    bound: int
    length: int
    samples: int
    side: int


@lru_cache(maxsize=65536)
def header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps, hz, mode = BITRATES[version == 3, layer][bitrate - 1], RATES[version][rate], four[3] >> 6
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = (17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)
    bound = 32 if mode != 1 else 4 * ((four[3] >> 4 & 3) + 1)
    return Header(version, layer, not four[1] & 1, kbps, hz, mode, bound, length, samples, side)


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
        out.append(c)
    return out


CRC = _table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ b]
    return c


def protected_part(data: bytes, at: int, h: Header) -> bytes | None:
    """The bytes that a frame's checksum covers; None where they are not known (layer II)."""
    if h.layer == 3:
        return data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
    if h.layer == 1:
        n = 16 if h.mode == 3 else (h.bound + 32) // 2
        return data[at + 2 : at + 4] + data[at + 6 : at + 6 + n]
    return None


def syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def to_syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _text(body: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return body[1:].decode(kind, "replace")


def read_id3v2(data: bytes, at: int) -> tuple[int, dict[str, str], bool | None] | None:
    """(end, text frames, whether the tag's CRC is right) of a tag at a place, if there is one."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return None
    major, flags, size = data[at + 3], data[at + 5], syncsafe(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if flags & 0x10 else 0)
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    tags, right = {}, None
    if flags & 0x40 and len(body) >= 14:  # a shorter one is no extended header
        if major >= 4:
            skip, has = syncsafe(body[:4]), body[5] & 0x20
            if has and skip >= 12:
                five = body[7:12]
                right = (five[0] << 28 | syncsafe(five[1:5])) == zlib.crc32(body[skip:])
            body = body[skip:]
        else:
            skip, pad = struct.unpack(">I2xI", body[:10])
            if skip >= 10:
                right = struct.unpack(">I", body[10:14])[0] == zlib.crc32(body[4 + skip : len(body) - pad])
            body = body[4 + skip :]
    k = 0
    while k + 10 <= len(body) and body[k : k + 1].isalpha():
        name = body[k : k + 4].decode("latin-1")
        size = syncsafe(body[k + 4 : k + 8]) if major >= 4 else struct.unpack(">I", body[k + 4 : k + 8])[0]
        if name.startswith("T"):
            value = _text(body[k + 10 : k + 10 + size])
            if name == "TXXX":
                name, _, value = value.partition("\0")
            tags[name] = value.rstrip("\0")
        k += 10 + size
    return min(end, len(data)), tags, right


@dataclass
class Index:
    tags: dict[str, str] = field(default_factory=dict)
    tag_right: bool | None = None
    offsets: list[int] = field(default_factory=list)  # of audio frames
    headers: list[Header] = field(default_factory=list)
    seconds: Fraction = Fraction(0)
    samples: int = 0
    checked: int = 0
    wrong: int = 0
    resyncs: int = 0
    junk: int = 0
    vbr: str = "none"
    _lost: bool = False
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: list[int] = field(default_factory=list)  # byte offsets from the start of the stream


def read_vbr(data: bytes, at: int, h: Header, out: Index) -> bool:
    """Fills in what a Xing, Info or VBRI frame says; whether the frame is one. A frame that is too short
    for what its table would hold is none, and is left as audio."""
    frame = data[at : at + h.length]
    x = 4 + (2 if h.protected else 0) + h.side
    for x in (x, x - 2):
        if frame[x : x + 4] in (b"Xing", b"Info") and len(frame) >= x + 8:
            flags, k = int.from_bytes(frame[x + 4 : x + 8], "big"), x + 8
            sizes = [4 if flags & 1 else 0, 4 if flags & 2 else 0, 100 if flags & 4 else 0]
            if len(frame) < k + sum(sizes):
                return False
            parts = [frame[k + sum(sizes[:i]) : k + sum(sizes[: i + 1])] for i in range(3)]
            out.vbr = frame[x : x + 4].decode().lower()
            if parts[0]:
                out.vbr_frames = int.from_bytes(parts[0], "big")
            if parts[1]:
                out.vbr_bytes = int.from_bytes(parts[1], "big")
            if parts[2]:
                total = out.vbr_bytes or len(data) - at
                out.toc = [at + b * total // 256 for b in parts[2]]
            return True
    x = 36
    if frame[x : x + 4] == b"VBRI" and len(frame) >= x + 26:
        _, _, _, size, frames, n, scale, width, _ = struct.unpack(">HHHIIHHHH", frame[x + 4 : x + 26])
        if len(frame) < x + 26 + n * width:
            return False
        out.vbr, out.vbr_bytes, out.vbr_frames = "vbri", size, frames
        place = at + h.length
        for k in range(n):
            out.toc.append(place)
            place += int.from_bytes(frame[x + 26 + k * width : x + 26 + (k + 1) * width], "big") * scale
        return True
    return False


def index(data: bytes | None) -> Index:
    out, at, last = Index(), 0, None
    if not data:
        return out
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) >= 128 else len(data)
    if end < len(data):
        t = data[-128:]
        out.tags |= {k: v for k, v in (("title", t[3:33]), ("artist", t[33:63])) for v in [v.rstrip(b"\0 ").decode("latin-1")] if v}
    first = True
    rates: dict[int, int] = {}
    while at < end:
        if data[at] == 0x49 and (tag := read_id3v2(data, at)):
            at, tags, out.tag_right = tag
            out.tags |= tags
            continue
        h = header(data[at : at + 4])
        fits = h and at + h.length <= end
        if fits and last is not None:
            fits = (h.version, h.layer, h.rate) == last
        if fits and last is None:  # the first header, or one after junk, needs what follows to agree
            n = header(data[at + h.length : at + h.length + 4])
            fits = at + h.length == end or data[at + h.length : at + h.length + 3] == b"ID3" or (n and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate))
        if not fits:
            if h and at + h.length > end and last is not None:  # cut within a frame
                out.junk += end - at
                break
            start, last = at, None
            at = data.find(b"\xff", at + 1, end)
            tag_at = data.find(b"ID3", start + 1, end if at < 0 else at)
            at = tag_at if tag_at >= 0 else at
            out.resyncs += not first and not out._lost
            out._lost = True
            out.junk += (end if at < 0 else at) - start
            if at < 0:
                break
            continue
        out._lost = False
        last = (h.version, h.layer, h.rate)
        if not (first and h.layer == 3 and read_vbr(data, at, h, out)):
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
            rates[h.rate] = rates.get(h.rate, 0) + h.samples
        first = False
        if h.protected and (part := protected_part(data, at, h)) is not None:
            out.checked += 1
            out.wrong += crc16(part) != data[at + 4] << 8 | data[at + 5]
        at += h.length
    out.seconds = sum((Fraction(n, hz) for hz, n in rates.items()), Fraction(0))
    return out


def payload(data: bytes, found: Index) -> bytes:
    """The payload of a stored stream, from the main data areas; its CRC-32 must agree."""
    size, crc = found.tags[TAG_KEY].split(":")
    parts = [data[at + 6 + h.side : at + h.length] for at, h in zip(found.offsets, found.headers)]
    out = b"".join(parts)[: int(size)]
    if len(out) != int(size) or f"{zlib.crc32(out):08x}" != crc:
        raise ValueError("the stored payload does not agree with its checksum")
    return out


KBPS = BITRATES[True, 3]
STEREO_SIDE = 32


@lru_cache(maxsize=16)
def _head(k: int) -> bytes:
    """Header, checksum and empty side information of a protected 32 kHz frame of the k-th bitrate."""
    two = bytes([(k + 1) << 4 | 2 << 2, 0])
    return b"\xff\xfa" + two + struct.pack(">H", crc16(two + bytes(STEREO_SIDE))) + bytes(STEREO_SIDE)


SIZES = [144 * kbps // 32 for kbps in KBPS]
ROOM = [n - 6 - STEREO_SIDE for n in SIZES]


def store(data: bytes) -> bytes:
    """The payload as a stream."""
    frames, at = [], 0
    while at < len(data) or not frames:
        left = len(data) - at
        k = next((i for i, room in enumerate(ROOM) if room >= left), len(ROOM) - 1)
        part = data[at : at + ROOM[k]]
        frames.append(_head(k) + part + bytes(ROOM[k] - len(part)))
        at += len(part)
    value = b"\0" + TAG_KEY.encode() + b"\0" + f"{len(data)}:{zlib.crc32(data):08x}".encode()
    body = b"TXXX" + struct.pack(">I2x", len(value)) + value
    body = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(body)) + body
    tag = b"ID3\x03\x00\x40" + to_syncsafe(len(body)) + body
    top = SIZES.index(next(n for n in SIZES if n >= 6 + STEREO_SIDE + 116))
    total = SIZES[top] + sum(map(len, frames))
    ends, place = [], SIZES[top]
    for f in frames:
        ends.append(place)
        place += len(f)
    toc = bytes(min(255, ends[i * len(frames) // 100] * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    xing = _head(top) + xing + bytes(ROOM[top] - len(xing))
    return b"".join([tag, xing, *frames, b"TAG" + bytes(124) + b"\xff"])


def padded(text: str | None) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return len(data), data + bytes(-len(data) % 64 or (0 if data else 64))


def stored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: every text, padded with zero bytes to a multiple of 64, as a stream."""

    def setup():
        def one(key, value):
            n, data = padded(value)
            return key, n, store(data)

        return one

    return map_rows(pick(docs, doc_id=doc_id, text=text), "doc_id long, n_bytes long, media binary", setup, 128)


def indexed(rows: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """For streams of any origin: key, tags, frames, samples, duration as a fraction of seconds,
    checked and wrong checksums, resynchronisations, junk bytes, what the variable-bitrate table
    says, and the offset of every frame."""

    def setup():
        def one(k, data):
            x = index(bytes(data) if data else b"")
            return k, x.tags, len(x.offsets), x.samples, x.seconds.numerator, x.seconds.denominator, x.checked, x.wrong, x.resyncs, x.junk, x.vbr, x.vbr_frames, x.vbr_bytes, x.toc, x.offsets

        return one

    ddl = "doc_id long, tags map<string,string>, frames long, samples long, seconds_over long, seconds_under long, checked long, wrong long, resyncs long, junk long, vbr string, vbr_frames long, vbr_bytes long, toc array<long>, offsets array<long>"
    return map_rows(pick(rows, doc_id=key, media=media), ddl, setup, 128)


def features(rows: DataFrame) -> DataFrame:
    """From doc_id, n_bytes, media: what is read back, and a feature string of the index."""

    def setup():
        def one(key, n, media):
            media = bytes(media)
            x = index(media)
            data = payload(media, x)
            seeks = hashlib.sha256(struct.pack(f">{len(x.offsets)}Q", *x.offsets)).hexdigest()[:16]
            mean = Fraction(8 * sum(h.length for h in x.headers)) / x.seconds / 1000
            said = f"frames={len(x.offsets)};samples={x.samples};seconds={x.seconds};kbps={float(mean):.3f};vbr={x.vbr}:{x.vbr_frames}:{x.vbr_bytes};toc={len(x.toc)};checked={x.checked};wrong={x.wrong};tag_crc={x.tag_right};resyncs={x.resyncs};first={x.offsets[0]};last={x.offsets[-1]};seeks={seeks}"
            return key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), said

        return one

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(rows.select("doc_id", "n_bytes", F.col("media")), ddl, setup, 128)


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(table(spark, sf_dir, "documents")))
