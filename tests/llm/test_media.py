import hashlib
import zlib

import numpy as np
import pytest
from graphloom.llm import media
from graphloom.llm.media import Jpeg, NotReadable, decode, decode_each, encode_payload, media_column, media_features, padded, parse, read_payload, thumbnail


def test_round_trip_of_any_bytes():
    rnd = np.random.default_rng(1)
    payloads = [padded(rnd.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 1, 576, 577, 5000)] + [b"\xff" * 576, bytes(576), b"\xff" * 576 * 9000]
    for payload, picture in zip(payloads, decode([encode_payload(p, b"0 %d" % len(p)) for p in payloads]), strict=True):
        assert read_payload(picture) == (0, payload)


def _bits(*fields):
    text = "".join(format(v, f"0{n}b") for v, n in fields)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_general_baseline_file():
    """Three components, 4:2:0, run lengths, end of block, negative values, quantisation 16, no restart markers."""
    dc = bytes([0, 3] + [0] * 14 + [0, 4, 5])  # 00: 0, 01: 4, 10: 5
    ac = bytes([0, 3] + [0] * 14 + [0x00, 0x31, 0xF0])  # 00: end, 01: run 3 size 1, 10: sixteen zeros
    block = lambda v: [(0b10, 2), ((v if v > 0 else v + 31), 5)] if abs(v) > 15 else [(0b01, 2), ((v if v > 0 else v + 15), 4)]
    flat = [(0b00, 2)]
    mcu = [*block(20), (0b01, 2), (1, 1), (0b10, 2), (0b01, 2), (0, 1), *flat, *block(-9), *flat, (0b00, 2), *flat, *block(16), *flat, *block(-20), *flat, *block(8), *flat]
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    data = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC0, b"\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\0\x03\x11\0") + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + _bits(*mcu) + b"\xff\xd9"
    picture = decode([data])[0]
    luma = picture.coefficients[0].reshape(-1, 64)
    assert luma[:, 0].tolist() == [20, 11, 11, 27] and luma[0, 4] == 1 and luma[0, 24] == -1
    assert picture.coefficients[1][0, 0, 0] == -20 and picture.coefficients[2][0, 0, 0] == 8
    assert thumbnail(picture).tolist() == [[168, 150], [150, 182]]


def test_other_files_are_refused():
    for data in (b"", b"GIF89a", encode_payload(padded(b"x"), b"1 576").replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            parse(data)


def test_columns(spark):
    rows = [(1, "Grüße", 3), (1, "Grüße", 3), (2, None, 3), (3, "", 4), (None, "x" * 100_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    out = {r.doc_id: r for r in media_features(media_column(docs)).collect()}
    for i, text, _ in rows:
        payload = padded((text or "").encode())
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert out[2].feature == out[3].feature and out[2].media_sha256 == out[3].media_sha256
    assert media_features(media_column(docs)).count() == 5
    assert media_features(media_column(docs.limit(0))).count() == 0


def _segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dc_only(width, height, sampling, scans, restart=0):
    """A file whose blocks hold DC differences of size category 5 and nothing else; scans: [[(component, differences)]], a component alone or interleaved by MCU."""
    one = bytes([1] + [0] * 15)
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)])
    frame += b"".join(bytes([i + 1, s, 0]) for i, s in enumerate(sampling))
    out = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x08" * 64) + _segment(0xC0, frame) + _segment(0xC4, b"\0" + one + b"\x05") + _segment(0xC4, b"\x10" + one + b"\0")
    if restart:
        out += _segment(0xDD, restart.to_bytes(2, "big"))
    for parts, blocks in scans:
        out += _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in parts) + b"\0\x3f\0")
        out += _bits(*(f for v in blocks for f in ((0, 1), (v if v > 0 else v + 31, 5), (0, 1))))
    return out + b"\xff\xd9"


def test_files_of_several_scans():
    """4:2:0, 20 x 12: luminance alone has 3 x 2 blocks (no filling), each colour 2 x 1."""
    data = _dc_only(20, 12, [0x22, 0x11, 0x11], [([0], [16, 17, 18, -19, 20, -21]), ([1], [20, 21]), ([2], [-20, -21])])
    picture = decode([data])[0]
    assert [c.shape for c in picture.coefficients] == [(2, 3, 64), (1, 2, 64), (1, 2, 64)]
    assert picture.coefficients[0][..., 0].reshape(-1).tolist() == np.cumsum([16, 17, 18, -19, 20, -21]).tolist()
    assert picture.coefficients[2][..., 0].tolist() == [[-20, -41]] and thumbnail(picture).shape == (2, 3)
    with pytest.raises(NotReadable):
        parse(_dc_only(20, 12, [0x22, 0x11, 0x11], [([0], [16] * 6), ([1], [20, 21])]))


def test_lanes_in_step_and_in_turn_agree(monkeypatch):
    rnd = np.random.default_rng(3)
    files = [_dc_only(8 * n, 40, [0x11], [([0], [int(v) for v in rnd.choice([-31, -17, 16, 30], 5 * n)])]) for n in (1, 7, 40)] + [encode_payload(padded(bytes([i]) * 900), b"900 1152") for i in range(4)]
    turn = decode(files)
    monkeypatch.setattr(media, "LEAST_LANES", 1)
    for a, b in zip(turn, decode(files), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a.coefficients, b.coefficients, strict=True))


def test_bad_files_cost_themselves_only(spark):
    good = encode_payload(padded(b"abc"), b"3 576")
    other = _dc_only(16, 8, [0x11], [([0], [16, 17])])
    bad = [None, b"", b"GIF89a", good[:40], good[:-100], good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xda", good.replace(b"\0\x08\0\x48\x01", b"\xff\xff\xff\xff\x01"), other[:-5]]
    rnd = np.random.default_rng(4)
    for _ in range(150):  # whatever bytes change, a picture or a reason comes back
        hurt = bytearray(good)
        hurt[rnd.integers(len(good))] = rnd.integers(256)
        bad.append(bytes(hurt)[: rnd.integers(1, len(good) + 1)])
    found = decode_each([good, *bad, good])
    assert read_payload(found[0]) == read_payload(found[-1]) == (3, padded(b"abc"))
    assert all(isinstance(x, NotReadable) for x in found[1:11]) and all(isinstance(x, (Jpeg, NotReadable)) for x in found)
    rows = [(i, None if d is None else bytearray(d)) for i, d in enumerate([good, *bad[:10], other])]
    out = {r.doc_id: r for r in media_features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert out[0].error is None and out[0].n_bytes == 3 and all(out[i].error and out[i].n_bytes is None for i in range(1, 12))
    assert out[1].media_bytes is None and out[2].media_bytes == 0 and out[11].feature.startswith("16x8:2x1:")
