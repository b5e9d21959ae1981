"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

A bin is filled greedily with the longest document that fits; then its smallest document is replaced with the two
unpacked documents that fit the gap, widened by that document, most tightly, if they leave less of it. Which
documents of one length take part makes no difference, so the plan needs their counts alone: at most `size` numbers.
As long as the counts last, the same bin comes again, so a plan is a list of patterns with a multiplicity.
Documents find their places by their rank among those of their length; nothing else is moved.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.batches import parts
from graphloom.scratch import Scratch

#: Documents of one length are dealt to parts of about so many while they are ranked, for a length may hold a third of all rows; and how many parts there are about at most.
PART_ROWS, MOST_PARTS = 512, 65_536
#: The pattern that splits text before the merges of the byte-level vocabulary (fixed).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The faster library's pattern engine fails on a white-space run of a million characters; runs of this length are merged here.
LONG_RUN = 500_000
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = regex.compile(f"{_SPACE}++")


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 bytes are themselves, others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_assumed(spec: dict, vocabulary: dict[str, int]) -> bool:
    """Whether a tokenizer file does no more than the merges in order of rank over pieces by the pattern; its added tokens are taken as they stand."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
        return False
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary.get(a + b, -1) for a, b in merges]
    return all(x < y for x, y in zip([-1, *ids], ids, strict=False))


class IdEncoder:
    """Token ids of whole texts by a tokenizer file, as its library gives them without begin, end or padding.

    Where the file is a byte-level BPE in whose vocabulary a token's id is its rank, the merges are done by a faster library over the same
    ranks and the same pattern, which gives the same ids; very long white-space runs, on which its pattern engine fails, are merged here.
    Any other file is left to its own library. Strings of special tokens inside a text become those tokens, as the library does by default.
    """

    def __init__(self, file: str):
        library = tokenizers.Tokenizer.from_file(file)
        library.no_padding()
        library.no_truncation()
        self.library = library
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.fast = _as_assumed(json.loads(library.to_str()), library.get_vocab())
        if not self.fast:
            return
        place = _byte_of_character()
        self.ranks = {bytes(place[c] for c in token): i for token, i in library.get_vocab().items() if token not in self.special}
        self.merge = tiktoken.Encoding(file, pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode(self, text: str) -> list[int]:
        if not self.fast:
            return self.library.encode(text, add_special_tokens=False).ids
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.split.split(text)):
            out += [self.special[part]] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens. The pattern always cuts before a white-space run, and before its last character if more text follows."""
        if len(text) < LONG_RUN:
            return self.merge(text)
        out, at = [], 0
        for run in _SPACES.finditer(text):
            if run.end() - run.start() < LONG_RUN:
                continue
            end = run.end() - (run.end() < len(text))
            out += self.merge(text[at : run.start()])
            out += self.merge_long(text[run.start() : end].encode())
            at = end
        return out + self.merge(text[at:])

    def merge_long(self, piece: bytes) -> list[int]:
        """The merges of one long piece of few different bytes: all places of the pair of least rank at once.

        That is the order of the merges one by one, for a pair with a new token has a greater rank than the token itself.
        """
        values, codes = np.unique(np.frombuffer(piece, dtype=np.uint8), return_inverse=True)
        names = [bytes([v]) for v in values.tolist()]
        codes = codes.astype(np.int32)
        while len(codes) > 1:
            k = len(names)
            there = np.flatnonzero(np.bincount(codes[:-1] * k + codes[1:], minlength=k * k)).tolist()
            ranked = [(self.ranks[names[p // k] + names[p % k]], p) for p in there if names[p // k] + names[p % k] in self.ranks]
            if not ranked:
                break
            a, b = divmod(min(ranked)[1], k)
            at = np.flatnonzero((codes[:-1] == a) & (codes[1:] == b))
            if a == b:  # in a run of one token every other pair, from the left
                starts = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, at, 0))
                at = at[(at - starts) % 2 == 0]
            if names[a] + names[b] not in names:
                names.append(names[a] + names[b])
            codes[at] = names.index(names[a] + names[b])
            keep = np.ones(len(codes), dtype=bool)
            keep[at + 1] = False
            codes = codes[keep]
        return np.array([self.ranks[n] for n in names])[codes].tolist()


@functools.lru_cache(maxsize=2)
def encoder(file: str) -> IdEncoder:
    return IdEncoder(file)


def cut_pieces(docs: DataFrame, tokenizer_file: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the id `end`, cut into pieces of `size`.

    Only longer documents are cut; the first piece may be shorter, all others are full. A null or empty text has the
    one id `end`. Repeated rows give repeated pieces.
    """
    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids_of = encoder(tokenizer_file)
        for texts in parts(batches):
            out = []
            for text in texts:
                ids = np.array([*ids_of.encode(text or ""), end], dtype="<u4")
                bounds = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                out.append([{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b])} for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])
            yield pd.Series(out)

    return docs.select("doc_id", F.explode(pieces("text")).alias("p")).select("doc_id", "p.*")


def plan_bins(counts: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """[(multiplicity, lengths)]: bins for counts[l] documents of each length l, by best-two-fit.

    Every document is in one bin, no bin is longer than `size`, and none is empty.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[int, list[int]]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        used: dict[int, int] = {}
        gap, top = size, len(there) - 1
        while True:
            top = min(top, int(np.searchsorted(there, gap, side="right")) - 1)
            while top >= 0 and used.get(int(there[top]), 0) >= left[there[top]]:
                top -= 1
            if top < 0:
                break
            length = int(there[top])
            n = min(gap // length, int(left[length]) - used.get(length, 0))
            used[length] = used.get(length, 0) + n
            gap -= n * length
        if gap and len(used) + max(used.values()) > 2:
            _swap_smallest(used, left, gap)
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        plan.append((times, sorted((length for length, n in used.items() for _ in range(n)), reverse=True)))


def _swap_smallest(used: dict[int, int], left: np.ndarray, gap: int) -> None:
    """Replaces the bin's smallest document with the two unpacked ones that fill the widened gap best, if they fill more of it."""
    smallest = min(used)
    room = gap + smallest
    free = left[: room + 1].copy()
    for length, n in used.items():
        if length <= room:
            free[length] -= n
    lengths = np.flatnonzero(free > 0)
    if not len(lengths):
        return
    at = np.searchsorted(lengths, room - lengths, side="right") - 1  # the longest partner of each
    same = (at >= 0) & (lengths[at] == lengths) & (free[lengths] < 2)
    at = np.where(same, at - 1, at)
    total = np.where(at >= 0, lengths + lengths[at], 0)
    best = int(total.argmax())
    if total[best] <= smallest:
        return
    used[smallest] -= 1
    if not used[smallest]:
        del used[smallest]
    for length in (int(lengths[best]), int(lengths[at[best]])):
        used[length] = used.get(length, 0) + 1


def best_two_fit(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset: gapless from 0 in each sequence, none longer than `size`.

    Lengths must lie between 1 and `size`. Pieces of one length take the plan's places in an order given by
    their salt and doc_id; equal rows are interchangeable. An empty table gives no rows.
    """
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession, "packing")
    held = scratch.table(pieces.withColumn("_hash", F.xxhash64(*pieces.columns)))
    lengths = held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # `size` rows at most
    each = max(PART_ROWS, int(lengths["n"].sum()) // MOST_PARTS)
    lengths["_parts"] = -(-lengths["n"] // each)
    parts_of = spark.createDataFrame(lengths[["length", "_parts"]] if len(lengths) else [], "length long, _parts long")
    salted = held.join(F.broadcast(parts_of), "length").withColumn("_salt", F.pmod("_hash", "_parts").cast("int"))  # a row for each length
    cells = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).toPandas()  # `size` + MOST_PARTS rows at most
    cells = cells.sort_values(["length", "_salt"], ignore_index=True)
    counts = np.zeros(size + 1, dtype=np.int64)
    np.add.at(counts, cells["length"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=np.int64))
    cells["_before"] = cells.groupby("length")["n"].cumsum() - cells["n"] if len(cells) else cells["n"]
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    base, taken = 0, np.zeros(size + 1, dtype=np.int64)
    for times, lengths in plan_bins(counts, size):
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            places.setdefault(length, []).append((int(taken[length]), base, n, offset))
            taken[length] += times * n
            offset += n * length
        base += times
    columns = {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for length, rows in places.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        value, rank = lengths.to_numpy(), ranks.to_numpy()
        order = np.argsort(value, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(group):
                starts, bases, per_bin, offsets = columns[int(value[group[0]])]
                k = np.searchsorted(starts, rank[group], side="right") - 1
                inside = rank[group] - starts[k]
                sequence[group] = bases[k] + inside // per_bin[k]
                offset[group] = offsets[k] + inside % per_bin[k] * value[group[0]]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    scratch.keep(held)
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "_hash")
    before = spark.createDataFrame(cells[["length", "_salt", "_before"]] if len(cells) else [], "length long, _salt int, _before long")
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(before, ["length", "_salt"])
    placed = ranked.withColumn("_at", place("length", F.col("_before") + F.col("_rank") - 1))
    return placed.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs(doc_id, text)."""
    return best_two_fit(cut_pieces(docs, tokenizer_file, size, end), size)
