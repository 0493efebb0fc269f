import hashlib
import os
import struct
import zlib
from fractions import Fraction

from spectraloom.llm import audio


def test_round_trip_and_index():
    for n in (0, 1, 64, 1402, 1403, 100_000):
        data = os.urandom(n)
        media = audio.store(data)
        x = audio.index(media)
        assert audio.payload(media, x) == data
        assert (x.wrong, x.resyncs, x.junk, x.tag_right, x.vbr) == (0, 0, 0, True, "xing")
        assert x.vbr_frames == len(x.offsets) and x.seconds == Fraction(1152 * len(x.offsets), 32000)
        assert all(media[o : o + 2] == b"\xff\xfa" for o in x.offsets)


def test_resynchronises_after_junk_and_finds_wrong_checksums():
    media = audio.store(bytes(range(200)) * 100)
    x = audio.index(media)
    a, b = x.offsets[3], x.offsets[5]
    spoiled = media[:a] + b"\xff\xfb junk \xff" * 9 + media[a:b] + media[b : b + 8] + b"\x55" + media[b + 9 :]
    y = audio.index(spoiled)
    assert (len(y.offsets), y.resyncs, y.wrong, y.junk) == (len(x.offsets), 1, 1, 81)
    assert y.seconds == x.seconds and y.offsets[:3] == x.offsets[:3] and y.offsets[3] == a + 81
    assert len(audio.index(media[:-700]).offsets) < len(x.offsets)
    assert audio.index(None).offsets == [] and audio.index(b"no audio").seconds == 0


def test_vbri_layers_and_tags():
    frame = audio._head(13) + bytes(audio.ROOM[13])
    table = struct.pack(">HHHIIHHHH", 1, 0, 50, 3 * len(frame), 2, 2, 1, 2, 1) + struct.pack(">HH", len(frame), len(frame))
    head = bytearray(frame)
    head[36 : 36 + 4 + len(table)] = b"VBRI" + table
    body = b"TIT2" + struct.pack(">I2x", 3) + b"\x03Hi"
    tag = b"ID3\x03\x00\x00" + audio.to_syncsafe(len(body)) + body
    x = audio.index(tag + bytes(head) + frame * 2)
    assert x.vbr == "vbri" and x.vbr_frames == 2 and x.tags["TIT2"] == "Hi" and x.toc == x.offsets
    one = audio.header(b"\xff\xff\x50\x00")
    assert (one.layer, one.length, one.samples) == (1, 12000 * 160 // 44100 * 4, 384)
    assert audio.header(b"\xff\xf3\x84\x00").samples == 576 and audio.header(b"\xff\xfb\x00\x00") is None


def test_query_columns(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "é" * 5000, 0), (4, "é" * 5000, 0)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in audio.features(audio.stored(docs)).collect()}
    for i, t in ((1, ""), (2, ""), (3, "é" * 5000)):
        n, data = audio.padded(t)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[1].payload_bytes == 64 and got[3][1:] == got[4][1:]
    x = audio.indexed(audio.stored(docs)).where("doc_id = 3").first()
    assert x.frames == len(x.offsets) and x.wrong == 0
    assert audio.features(audio.stored(docs.limit(0))).collect() == []


def test_malformed_extended_headers():
    """No tag, however broken, stops the index."""
    import random

    r = random.Random(4)
    whole = audio.store(b"some payload" * 20)
    for major in (3, 4):
        for _ in range(400):
            n = r.randint(0, 24)
            body = bytes(r.randrange(256) for _ in range(n))
            tag = b"ID3" + bytes([major, 0, 0x40 | r.choice((0, 0x80, 0x10))]) + audio.to_syncsafe(n) + body
            found = audio.index(tag + whole)
            assert found is not None
            audio.index(tag)


def test_seek_tables_in_short_frames():
    """A table that does not fit into its frame is no table, wherever the frame or the stream ends."""
    import random

    r = random.Random(6)
    frames = [head + bytes(audio.header(head).length - 4) for head in (b"\xff\xfb\x10\x00", b"\xff\xfb\x14\xc0", b"\xff\xe3\x14\x00", b"\xff\xf3\x14\xc0", b"\xff\xfb\xe0\x00")]
    for frame in frames:
        for mark in (b"Xing", b"Info", b"VBRI"):
            for flags in (0, 1, 3, 7, 0xFFFFFFFF):
                for x in (4, 13, 19, 21, 34, 36, len(frame) - 8, len(frame) - 4, len(frame) - 2):
                    first = bytearray(frame)
                    first[x : x + 8] = mark + struct.pack(">I", flags)
                    first = bytes(first[: len(frame)])
                    for stream in (first, first + frame, first + frame * 3, first + frame[: r.randint(1, len(frame))]):
                        found = audio.index(stream)
                        assert all(0 <= o < len(stream) for o in found.offsets)
    for _ in range(3000):
        frame = r.choice(frames)
        first = bytearray(frame)
        x = r.randint(4, len(frame))
        first[x : x + 40] = r.choice((b"Xing", b"Info", b"VBRI")) + bytes(r.randrange(256) for _ in range(r.randint(0, 36)))
        audio.index((bytes(first) + frame * r.randint(0, 2))[: r.randint(1, 3 * len(frame))])
