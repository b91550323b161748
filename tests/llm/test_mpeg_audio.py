from __future__ import annotations

import hashlib
import random
import zlib

from tidemill.llm import mpeg_audio as M


def test_round_trip_and_features(spark):
    texts = [None, "", "a", "é" * 64, "x" * 64, "x" * 63, "y" * 960, "z" * 961, "long " * 50_000, "a", "ID3ÿû" * 99]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    by_text: dict = {}
    for r in M.features(M.stored(df)).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.frames == -(-len(padded) // 960) == len(r.seek_offsets) and r.duration_us == r.frames * 36_000 and r.bad_frames == 0
        stored = M.encode(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert all(stored[o] == 0xFF and M.header_at(stored, o) for o in r.seek_offsets)
        assert by_text.setdefault(texts[r.doc_id], r.media_sha256) == r.media_sha256
    assert M.features(M.stored(df.limit(0))).count() == 0


def test_damage_is_skipped():
    payload = random.Random(1).randbytes(64 * 100)
    data = M.encode(payload)
    whole = M.decode(data)
    assert whole.payload == payload and whole.xing_frames == whole.frames == 7 and whole.xing_bytes == len(data) - 10 - 10 - 4
    at = whole.offsets[2]
    hurt = data[: at + 10] + bytes([data[at + 10] ^ 0x55]) + data[at + 11 :]
    got = M.decode(hurt)
    assert got.frames == 6 and got.bad == 1 and got.payload == payload[: 2 * 960] + payload[3 * 960 :]
    assert M.decode(b"junk\xff\xfa\x00" + data[24:]).payload == payload
    assert M.decode(b"").frames == 0


def frame(version: int, layer: int, index: int, rate: int, mode: int = 0, body: bytes = b"", crc: bool = False) -> bytes:
    """A frame of another writer: header bits by hand, lengths by the standard's formula."""
    head = bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (not crc), index << 4 | rate << 2, mode << 6])
    kbits, hertz = M.RATES[version == 3, layer][index], [44100, 48000, 32000][rate] // {3: 1, 2: 2, 0: 4}[version]
    length = 4 * (12_000 * kbits // hertz) if layer == 1 else (72_000 if layer == 3 and version != 3 else 144_000) * kbits // hertz
    if crc:
        covered = body[: 16 if mode == 3 else 32] if layer == 1 else body[: {(3, 3): 17, (3, 0): 32, (2, 3): 9, (2, 0): 17}[version or 2, mode]]
        check = 0xFFFF
        for bit in "".join(f"{x:08b}" for x in head[2:] + covered):
            check = (check << 1 ^ (0x8005 if (check >> 15) ^ int(bit) else 0)) & 0xFFFF
        head += check.to_bytes(2, "big")
    return (head + body).ljust(length, b"\x11")[:length]


def test_other_versions_and_layers():
    for version, layer, index, rate, samples, hertz in ((3, 1, 5, 0, 384, 44100), (3, 2, 8, 1, 1152, 48000), (3, 3, 9, 0, 1152, 44100), (2, 3, 8, 0, 576, 22050), (2, 2, 5, 2, 1152, 16000), (0, 3, 4, 2, 576, 8000), (2, 1, 3, 1, 384, 24000)):
        for mode, crc in ((0, False), (3, True)):
            one = frame(version, layer, index, rate, mode, b"\x01\x02" * 20, crc)
            m = M.decode(b"\xff\xe3junk" + one * 5)
            assert (m.frames, m.hertz, m.layer, m.bad, m.skipped) == (5, hertz, layer, 0, 6)
            assert m.offsets == [6 + k * len(one) for k in range(5)] and m.microseconds() == 5 * samples * 1_000_000 // hertz
            if crc and layer != 2 and (version, mode) in ((3, 3), (2, 3)):
                hurt = bytearray(one * 5)
                hurt[2 * len(one) + 7] ^= 0x40
                m = M.decode(bytes(hurt))
                assert (m.frames, m.bad) == (4, 1)


def test_variable_bitrate_tables():
    sound = [frame(3, 3, i, 0, 0, bytes([i]) * 40) for i in (9, 11, 5, 9, 14, 9, 3, 9)]
    total = sum(map(len, sound)) + len(frame(3, 3, 9, 0))
    seek = bytes(range(100))
    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1200).to_bytes(3, "big") + bytes(12)
    xing = b"Xing" + (15).to_bytes(4, "big") + (8).to_bytes(4, "big") + total.to_bytes(4, "big") + seek + bytes(4) + lame
    m = M.decode(frame(3, 3, 9, 0, 0, bytes(32) + xing) + b"".join(sound))
    assert (m.xing_frames, m.xing_bytes, m.frames, m.delay, m.padding) == (8, total, 8, 576, 1200)
    assert m.seek == [k * total // 256 for k in range(100)] and m.bitrates == {128: 4, 192: 1, 64: 1, 320: 1, 48: 1}
    assert m.microseconds() == (8 * 1152 - 1776) * 1_000_000 // 44100
    sound = [frame(2, 3, i, 0, 0) for i in (8, 9, 10, 11)]
    table = b"".join((len(x) // 2).to_bytes(2, "big") for x in sound)
    vbri = b"VBRI" + b"\0\1" + (1105).to_bytes(2, "big") + b"\0\x4b" + (9999).to_bytes(4, "big") + (4).to_bytes(4, "big") + (4).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + table
    m = M.decode(frame(2, 3, 8, 0, 0, bytes(32) + vbri) + b"".join(sound))
    assert (m.frames, m.xing_frames, m.xing_bytes, m.delay) == (4, 4, 9999, 1105)
    assert m.seek == [sum(len(x) // 2 * 2 for x in sound[:k]) for k in range(5)]


def test_tags_of_other_writers():
    sound = frame(3, 3, 9, 0) * 3

    def tag(version: int, frames: bytes, flags: int = 0) -> bytes:
        return b"ID3" + bytes([version, 0, flags]) + M.syncsafe(len(frames)) + frames

    def text(version: int, key: str, raw: bytes) -> bytes:
        n = len(raw)
        return key.encode() + (n.to_bytes(3, "big") if version == 2 else n.to_bytes(4, "big") + b"\0\0" if version == 3 else M.syncsafe(n) + b"\0\0") + raw

    cases = [
        (tag(2, text(2, "TT2", b"\0caf\xe9")), {"TT2": "café"}), (tag(3, text(3, "TIT2", b"\1" + "żółw 🐢".encode("utf-16")) + text(3, "TPE1", b"\0x" * 1)), {"TIT2": "żółw 🐢", "TPE1": "x"}),
        (tag(4, text(4, "TIT2", b"\2" + "né".encode("utf-16-be")) + text(4, "TALB", b"\3" + "é".encode() * 150)), {"TIT2": "né", "TALB": "é" * 150}),
        (tag(3, (6).to_bytes(4, "big") + bytes(6) + text(3, "TIT2", b"\0ok"), 0x40), {"TIT2": "ok"}), (tag(3, text(3, "TIT2", b"\0\xff\xe0!").replace(b"\xff", b"\xff\x00"), 0x80), {"TIT2": "ÿà!"}),
    ]
    for head, tags in cases:
        m = M.decode(head + sound)
        assert m.tags == tags and m.frames == 3 and m.skipped == 0 and m.offsets[0] == len(head)
    item = (2).to_bytes(4, "little") + bytes(4) + b"Title\0hi"
    ape = item + b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    old = b"TAG" + b"song".ljust(30, b"\0") + b"who".ljust(30) + bytes(30) + b"1999" + bytes(31)
    m = M.decode(sound + ape + old)
    assert m.frames == 3 and m.skipped == 0 and m.tags == {"title": "song", "artist": "who", "year": "1999", "Title": "hi"}
    assert M.decode(b"ID3\x04\0\0\x7f\x7f\x7f\x7f").frames == 0


def test_own_seek_table(spark):
    """The table's points are at the frames of the hundredths of the duration, to a 256th of the file."""
    data = M.encode(random.Random(2).randbytes(64 * 900))
    m = M.decode(data)
    start = m.offsets[0] - M.frame_bytes(5, M.RATE, 0)
    assert len(m.seek) == 100 and all(0 <= m.offsets[m.frames * p // 100] - start - x <= m.xing_bytes / 256 + 1 for p, x in enumerate(m.seek))
