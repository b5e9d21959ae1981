"""Word shingles of whole texts as 64-bit hashes, and fast similarity sketches of the shingle sets.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D) after lower-casing A-Z.
Everything is vectorised over the bytes of one text; texts are walked in pieces cut at white space, so the
working set stays small however long a text is.
"""

from __future__ import annotations

import re

import numpy as np

_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_U = np.uint64


def _stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        return mix(_U(seed) + _U(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _stream(1, 256)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; grown by doubling."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _piece_words(piece: bytes) -> np.ndarray:
    codes = np.frombuffer(piece, dtype=np.uint8)
    inside = np.concatenate(([False], ~_IS_SPACE[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[codes] * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the whole text, in order; null and empty texts have none."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
    if len(raw) <= _PIECE:
        return _piece_words(raw)
    parts, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, min(at + _PIECE, len(raw)))
        end = cut.start() if cut else len(raw)
        parts.append(_piece_words(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of `width` words.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), dtype=np.uint64)
    for j in range(min(width, len(words))):
        out = mix(out * _U(0xD6E8FEB86659FD93) + words[j : j + n])
    return np.unique(out)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set: two independent sums over its members, as signed longs."""
    a = mix(hashes ^ _U(0x243F6A8885A308D3)).sum(dtype=np.uint64)
    b = mix(hashes ^ _U(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def fast_similarity_sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketching: `size` coordinates, each the least value thrown into its bin.

    Round i < size throws every member into a bin chosen by that round's hash, with the value (i, rest of the hash);
    round size + b throws every member into bin b, so that all bins are filled after 2 * size rounds at most. It
    stops as soon as every bin is filled. Two sets agree in a coordinate with the probability of their Jaccard
    similarity, and the share of agreeing coordinates concentrates as for as many independent permutations.
    Rounds run together in blocks; a block's later rounds cannot change a bin that an earlier round filled.
    """
    filled = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(hashes):
        return filled
    at, seeds = 0, _round_seeds(size)
    while at < 2 * size:
        n = max(1, min(4096 // len(hashes), size - at if at < size else 2 * size - at))
        thrown = mix(hashes[None, :] ^ seeds[at : at + n, None])
        rounds = np.arange(at, at + n, dtype=np.uint64)[:, None]
        if at < size:
            bins = ((thrown >> _U(32)) * _U(size)) >> _U(32)
        else:
            bins = np.broadcast_to(rounds - _U(size), thrown.shape)
        values = (rounds << _U(48)) | (mix(thrown) >> _U(16))
        np.minimum.at(filled, bins.ravel().astype(np.intp), values.ravel())
        at += n
        if filled.max() != np.iinfo(np.uint64).max:
            break
    return filled


_seeds: dict[int, np.ndarray] = {}


def _round_seeds(size: int) -> np.ndarray:
    if size not in _seeds:
        _seeds[size] = _stream(2, 2 * size)
    return _seeds[size]


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates; the band's number is part of the key. Signed longs."""
    bands = sketch[: len(sketch) // rows * rows].reshape(-1, rows)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for j in range(rows):
        out = mix(out * _U(0xA0761D6478BD642F) + bands[:, j])
    return out.view(np.int64)
