"""Media columns: baseline JPEG files made and read in numpy.

The reader parses the markers, Huffman-decodes the scans and gives every quantised coefficient; luminance thumbnails come
from the DC coefficients alone. It takes any baseline (sequential Huffman, 8 bit) file, of one scan or several: the restart intervals
of many files with the same tables are lanes that are decoded in step, one symbol of each at a time; few lanes are decoded in turn.

The writer stores bytes as quantised coefficients, 64 to a block, which JPEG keeps exactly (only the transform to
pixels loses anything): coefficient = 256 + byte, so that all have one size category and one-bit Huffman codes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The payload is padded to a positive multiple of this many bytes: nine blocks, one row of the picture.
UNIT, PAD = 576, 255
#: About how many bytes of files are decoded together.
TOGETHER = 4_000_000
#: Blocks of a scan that is read at most (pictures of 268 megapixels), and lanes from which on they are decoded in step.
MOST_BLOCKS, LEAST_LANES = 1 << 22, 24
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_ROW = UNIT // 64
_MOST_ROWS = 65535 // 8
#: Zigzag position -> row * 8 + column (fixed by the format).
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), dtype=np.int64)


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data + bytes([PAD]) * ((-len(data)) % UNIT or (0 if data else UNIT))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_payload(payload: bytes, note: bytes) -> bytes:
    """A greyscale baseline JPEG whose coefficients hold the payload (a multiple of UNIT bytes); note: its comment."""
    rows = len(payload) // UNIT
    wide = -(-rows // _MOST_ROWS)
    high = -(-rows // wide)
    blocks = np.zeros((high * wide * _ROW, 64), dtype=np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    v = blocks.astype(np.uint16).reshape(-1, 16, 4) | 256  # ten bits: the code 0, then nine bits of the coefficient
    packed = np.stack([v[..., 0] >> 2, (v[..., 0] & 3) << 6 | v[..., 1] >> 4, (v[..., 1] & 15) << 4 | v[..., 2] >> 6, (v[..., 2] & 63) << 2 | v[..., 3] >> 8, v[..., 3]], axis=-1)
    scan = np.empty((len(blocks), 82), dtype=np.uint8)
    scan[:, :80] = packed.astype(np.uint8).reshape(-1, 80)
    scan[:, 80], scan[:, 81] = 0xFF, 0xD0 + np.arange(len(blocks)) % 8  # a restart after every block
    stuffed = scan == 0xFF
    stuffed[:, 80] = False
    twice = 1 + stuffed.reshape(-1)
    out = np.repeat(scan.reshape(-1), twice)
    out[np.cumsum(twice)[stuffed.reshape(-1)] - 1] = 0
    one_code = bytes([1] + [0] * 15 + [9])  # one code of one bit, for size category 9 (after a run of no zeros)
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xFE, note) + _segment(0xDB, b"\0" + b"\1" * 64)
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * _ROW * 8, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + one_code) + _segment(0xC4, b"\x10" + one_code)
    return head + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, b"\1\1\0\0\x3f\0") + out[:-2].tobytes() + b"\xff\xd9"


class NotReadable(ValueError):
    """What keeps a file from being read as a baseline JPEG."""


@dataclass
class Scan:
    """The parts of a component's or several components' picture: (component's place, DC table, AC table) each, the tables and restart interval then in force, and the coded bytes."""

    parts: list[tuple[int, int, int]]
    huffman: dict[int, bytes]
    restart: int
    body: bytes


@dataclass
class Jpeg:
    """What the markers of one file say, and after decoding its coefficients: (rows, columns, 64) in zigzag order for each component."""

    width: int = 0
    height: int = 0
    comments: list[bytes] = field(default_factory=list)
    quantisation: dict[int, np.ndarray] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantisation table
    scans: list[Scan] = field(default_factory=list)
    coefficients: list[np.ndarray] = field(default_factory=list)

    def sampling(self, place: int) -> tuple[int, int, int, int]:
        """(across, down, greatest across, greatest down) of a component. The only one of a picture counts as not subsampled."""
        if len(self.components) == 1:
            return 1, 1, 1, 1
        return *self.components[place][1:3], max(c[1] for c in self.components), max(c[2] for c in self.components)

    def layout(self, scan: Scan) -> tuple[int, int]:
        """MCUs across and down. A component that has a scan of its own is dealt by its own blocks, without filling."""
        h, v, hs, vs = self.sampling(scan.parts[0][0])
        if len(scan.parts) > 1:
            return -(-self.width // (8 * hs)), -(-self.height // (8 * vs))
        return -(-(-(-self.width * h // hs)) // 8), -(-(-(-self.height * v // vs)) // 8)

    def units(self, scan: Scan) -> list[tuple[int, int, int]]:
        """(place, DC table, AC table) of each block of an MCU."""
        if len(scan.parts) == 1:
            return list(scan.parts)
        return [part for part in scan.parts for _ in range(self.components[part[0]][1] * self.components[part[0]][2])]


def parse(data: bytes) -> Jpeg:
    """The headers and scans of a baseline file. Raises NotReadable on anything else."""
    try:
        return _parsed(data)
    except (LookupError, struct.error, ValueError) as e:
        raise e if isinstance(e, NotReadable) else NotReadable(f"a segment is cut off or wrong ({type(e).__name__})") from e


def _parsed(data: bytes) -> Jpeg:
    if data[:2] != b"\xff\xd8":
        raise NotReadable("no start of image")
    out, at, restart, huffman = Jpeg(), 2, 0, {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise NotReadable(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                out.quantisation[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.height or not out.width:
                raise NotReadable("not an 8-bit picture of known size")
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not n or any(not 1 <= x <= 4 for c in out.components for x in c[1:3]):
                raise NotReadable("components are wrong")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise NotReadable("not a baseline file")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            places = {c[0]: i for i, c in enumerate(out.components)}
            parts = [(places[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = _MARKER.search(data, at)
            end = end.start() if end else len(data)
            out.scans.append(Scan(parts, {k: huffman[k] for _, dc, ac in parts for k in (dc, 16 + ac)}, restart, data[at:end]))
            at = end
    if not out.scans:
        raise NotReadable("no scan")
    if sorted(p[0] for scan in out.scans for p in scan.parts) != list(range(len(out.components))):
        raise NotReadable("a component has no scan, or several")
    if any(len(out.quantisation.get(c[3], ())) != 64 for c in out.components):
        raise NotReadable("no quantisation table")
    for scan in out.scans:
        across, down = out.layout(scan)
        blocks = across * down * len(out.units(scan))
        if blocks > MOST_BLOCKS or blocks > 4 * len(scan.body):  # a block takes two bits at least
            raise NotReadable("the scan is too short for its picture" if blocks <= MOST_BLOCKS else f"more than {MOST_BLOCKS} blocks")
    return out


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: code length * 256 + symbol of the code they begin with; 0 where there is none."""
    out, code, at = np.zeros(1 << 16, dtype=np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _intervals(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffed zeros and markers, and the places where its restart intervals begin."""
    raw = np.frombuffer(body, dtype=np.uint8)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[marks + 1]
    restarts = marks[(follow >= 0xD0) & (follow <= 0xD7)]
    ends = marks[(follow != 0) & (follow != 0xFF) & ((follow < 0xD0) | (follow > 0xD7))]
    end = int(ends[0]) if len(ends) else len(raw)
    restarts = restarts[restarts < end]
    keep = np.ones(end, dtype=bool)
    zeros = marks[follow == 0] + 1
    keep[zeros[zeros < end]] = False
    keep[restarts] = False
    keep[restarts + 1] = False
    place = np.cumsum(keep)
    return raw[:end][keep], np.concatenate(([0], place[restarts])) if end else np.zeros(1, dtype=np.int64)


def decode(files: list[bytes]) -> list[Jpeg]:
    """The files with all coefficients. Scans with equal tables and layout are decoded together. Raises NotReadable if any file is not baseline."""
    pictures = [parse(data) for data in files]
    alike: dict[tuple, list[tuple[Jpeg, Scan]]] = {}
    for p in pictures:
        p.coefficients = [np.empty((0, 0, 64), np.int16)] * len(p.components)
        for scan in p.scans:
            key = (tuple(sorted(scan.huffman.items())), tuple(p.units(scan)), len(scan.parts))
            alike.setdefault(key, []).append((p, scan))
    for members in alike.values():
        _decode_alike(members)
    return pictures


def decode_each(files: list[bytes | None]) -> list[Jpeg | NotReadable]:
    """Each file's picture, or what kept it from being read; a bad file costs only itself."""
    out: list[Jpeg | NotReadable] = []
    try:
        return list(decode([f or b"" for f in files]))
    except NotReadable:
        for data in files:
            try:
                out += decode([data or b""])
            except NotReadable as e:
                out.append(NotReadable("no file") if data is None else e)
    return out


def _decode_alike(members: list[tuple[Jpeg, Scan]]) -> None:
    """Fills in the coefficients of scans whose tables and units are the same. Each restart interval is a lane."""
    units = members[0][0].units(members[0][1])
    per_mcu = len(units)
    bodies, begins, ends, at_mcu, lasts, spans, total, size = [], [], [], [], [], [], 0, 0
    for p, scan in members:
        body, starts = _intervals(scan.body)
        across, down = p.layout(scan)
        mcus = across * down
        step = scan.restart or mcus
        firsts = np.arange(0, mcus, step)
        if len(starts) < len(firsts):
            raise NotReadable("restart intervals are missing")
        begins.append(starts[: len(firsts)] + size)
        ends.append(np.append(starts, len(body))[1 : len(firsts) + 1] + size)
        at_mcu.append(firsts + total)
        lasts.append(np.minimum(firsts + step, mcus) + total)
        bodies.append(body)
        spans.append((total, total + mcus))
        total, size = total + mcus, size + len(body)
    joined = np.concatenate([*bodies, np.zeros(16, dtype=np.uint8)])
    out = np.zeros((total * per_mcu, 64), dtype=np.int16)
    tables = {k: lookup(v) for k, v in members[0][1].huffman.items()}
    lanes = np.concatenate(begins).astype(np.int64) * 8, np.concatenate(ends).astype(np.int64) * 8, np.concatenate(at_mcu), np.concatenate(lasts)
    (_decode_in_step if len(lanes[0]) >= LEAST_LANES else _decode_in_turn)(joined, lanes, units, tables, out)
    for (p, scan), (a, b) in zip(members, spans, strict=True):
        across, down = p.layout(scan)
        blocks = out[a * per_mcu : b * per_mcu].reshape(down, across, per_mcu, 64)
        at = 0
        for place, _, _ in scan.parts:
            h, v = p.components[place][1:3] if len(scan.parts) > 1 else (1, 1)
            mine = blocks[:, :, at : at + h * v].reshape(down, across, v, h, 64)
            p.coefficients[place] = mine.transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64)
            at += h * v


def _decode_in_step(joined: np.ndarray, lanes: tuple, units: list, tables: dict[int, np.ndarray], out: np.ndarray) -> None:
    """Many lanes: the next symbol of each at a time."""
    position, ends, mcu, last = lanes
    per_mcu = len(units)
    window = np.zeros(len(joined) - 8, dtype=np.uint64)  # the 64 bits that begin at each byte
    for i in range(8):
        window |= joined[i : i + len(window)].astype(np.uint64) << np.uint64(56 - 8 * i)
    before = np.zeros((max(u[0] for u in units) + 1, len(position)), dtype=np.int64)
    open_ = np.arange(len(position))

    def symbol(which: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each lane, and the value of the bits that its size category asks for."""
        p = position[which]
        if (p >= ends[which]).any():
            raise NotReadable("the scan is cut off")
        bits = window[p >> 3] << (p & 7).astype(np.uint64)
        hit = table[(bits >> np.uint64(48)).astype(np.int64)]
        if not hit.all():
            raise NotReadable("no such Huffman code")
        length, sign = hit >> 8, hit & 255
        category = sign & 15
        extra = ((bits << length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - category)
        position[which] = p + length + category
        return sign, np.where(extra < (1 << category >> 1), extra - (1 << category) + 1, extra)

    while len(open_):
        for u, (place, dc, ac) in enumerate(units):
            row = mcu[open_] * per_mcu + u
            _, value = symbol(open_, tables[dc])
            before[place, open_] += value
            out[row, 0] = before[place, open_]
            active, k = np.arange(len(open_)), np.ones(len(open_), dtype=np.int64)
            while len(active):
                sign, value = symbol(open_[active], tables[16 + ac])
                run, category = sign >> 4, sign & 15
                k[active] += run
                there = category > 0
                if not there.all():
                    ended = ~there & (run < 15)
                    k[active[ended]] = 64
                    k[active[~there & ~ended]] += 1
                    hit = active[there]
                    value = value[there]
                else:
                    hit = active
                if len(hit):
                    if k[hit].max() > 63:
                        raise NotReadable("a block runs over")
                    out[row[hit], k[hit]] = value
                    k[hit] += 1
                active = active[k[active] < 64]
        mcu[open_] += 1
        open_ = open_[mcu[open_] < last[open_]]
    if (position > ends).any():
        raise NotReadable("the scan is cut off")


def _decode_in_turn(joined: np.ndarray, lanes: tuple, units: list, tables: dict[int, np.ndarray], out: np.ndarray) -> None:
    """Few lanes: one after the other, a symbol at a time, in plain numbers."""
    data, per_mcu = joined.tobytes(), len(units)
    plain = {k: table.tolist() for k, table in tables.items()}
    for p, end, mcu, last in zip(*(x.tolist() for x in lanes), strict=True):
        before = [0] * (max(u[0] for u in units) + 1)
        for row in range(mcu * per_mcu, last * per_mcu):
            place, dc, ac = units[row % per_mcu]
            k, table, block = 0, plain[dc], [0] * 64
            while k < 64:
                if p >= end:
                    raise NotReadable("the scan is cut off")
                bits = int.from_bytes(data[p >> 3 : (p >> 3) + 8], "big") << (p & 7) & 0xFFFFFFFFFFFFFFFF
                hit = table[bits >> 48]
                if not hit:
                    raise NotReadable("no such Huffman code")
                length, run, category = hit >> 8, hit >> 4 & 15, hit & 15
                value = (bits << length & 0xFFFFFFFFFFFFFFFF) >> 32 >> (32 - category)
                if value < 1 << category >> 1:
                    value -= (1 << category) - 1
                p += length + category
                if not k:
                    before[place] += value
                    block[0], k, table = before[place], 1, plain[16 + ac]
                elif category:
                    k += run
                    if k > 63:
                        raise NotReadable("a block runs over")
                    block[k] = value
                    k += 1
                else:
                    k = k + 16 if run == 15 else 64
            out[row] = np.array(block, dtype=np.int64).astype(np.int16)
        if p > end:
            raise NotReadable("the scan is cut off")


def thumbnail(picture: Jpeg) -> np.ndarray:
    """A pixel for each luminance block: its mean, from the DC coefficient alone."""
    h, v, hs, vs = picture.sampling(0)
    mean = picture.coefficients[0][:, :, 0].astype(np.float64) * picture.quantisation[picture.components[0][3]][0] / 8 + 128
    wide, high = -(-picture.width * h // hs), -(-picture.height * v // vs)
    return np.clip(np.rint(mean), 0, 255).astype(np.uint8)[: -(-high // 8), : -(-wide // 8)]


def average_hash(pixels: np.ndarray, side: int = 8) -> str:
    """64 bits in hex: which cells of an 8 x 8 grid over the thumbnail are lighter than the mean of the cells."""
    sums = np.pad(pixels.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(side) * n // side
        return low, np.maximum(low + 1, np.arange(1, side + 1) * n // side)

    (top, bottom), (left, right) = bounds(pixels.shape[0]), bounds(pixels.shape[1])
    area = (bottom - top)[:, None] * (right - left)[None, :]
    cells = (sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]) / area
    return np.packbits(cells > cells.mean()).tobytes().hex()


def read_payload(picture: Jpeg) -> tuple[int, bytes]:
    """(bytes of the text, payload) that encode_payload stored; the comment has both lengths. Raises NotReadable for a picture of another kind."""
    note = re.fullmatch(rb"([0-9]{1,18}) ([0-9]{1,18})", picture.comments[0]) if picture.comments else None
    values = picture.coefficients[0].reshape(-1)
    if not note or int(note[2]) > len(values):
        raise NotReadable("no stored payload")
    return int(note[1]), (values[: int(note[2])] - 256).astype(np.uint8).tobytes()


def store_text(texts: pd.Series) -> pd.Series:
    """Each text's UTF-8 bytes (null: none), padded, as a JPEG file."""
    out = []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        payload = padded(data)
        out.append(encode_payload(payload, f"{len(data)} {len(payload)}".encode()))
    return pd.Series(out)


def media_facts(files: pd.Series) -> pd.DataFrame:
    """Facts of stored files, from their bytes alone."""
    out, group, size = [], [], 0
    for i, data in enumerate(files):
        group.append(None if data is None else bytes(data))
        size += len(data or b"")
        if size >= TOGETHER or i + 1 == len(files):
            out += [_facts(data, picture) for data, picture in zip(group, decode_each(group), strict=True)]
            group, size = [], 0
    return pd.DataFrame(out, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]).astype({"n_bytes": "Int64", "payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})


def _facts(data: bytes | None, picture: Jpeg | NotReadable) -> tuple:
    stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
    if isinstance(picture, NotReadable):
        return None, None, None, None, *stored, None, str(picture)
    small = thumbnail(picture)
    feature = f"{picture.width}x{picture.height}:{small.shape[1]}x{small.shape[0]}:{average_hash(small)}"
    try:
        n, payload = read_payload(picture)
    except NotReadable as e:
        return None, None, None, None, *stored, feature, str(e)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature, None


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the stored form of each whole text. A null text is stored as an empty one."""
    return docs.select("doc_id", F.pandas_udf(store_text, "binary")("text").alias("media"))


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error), read from the media column.

    feature: the picture's size, its thumbnail's size and the thumbnail's hash; equal texts have equal values. A file that is null,
    empty, cut off or no baseline JPEG has an error and nulls for what cannot be told; a baseline JPEG of another writer has a feature, an
    error and no payload. Repeated rows and null ids are returned as they come; an empty table gives no rows.
    """
    facts = F.pandas_udf(media_facts, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return media.select("doc_id", facts("media").alias("_facts")).select("doc_id", "_facts.*")
