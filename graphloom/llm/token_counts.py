"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The tokenizer merges adjacent pieces, best score first. For such a tokenizer a sequence of pieces is the
tokenization of its own text exactly if every two neighbours are, so each prefix has one last piece that follows the
tokenization of the prefix before it: count[i] = count[i - len(last)] + cost(last). No piece of the vocabulary runs on
into a later white-space mark, so the text falls into segments that can be counted alone; a segment's table is made
once and kept. A text's table is the running total at its segments plus the table inside one: every prefix is answered,
none is encoded again.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import parts

#: Segment totals and pairs of pieces that a worker keeps at most, and whole segment tables; beyond it starts anew.
#: Only the speed depends on them.
KEPT, KEPT_TABLES = 600_000, 100_000
#: Lengths of beginnings of segments whose tables are kept, so that words that begin alike share them.
PREFIXES = (9, 7, 5)
_MARK = "▁"


class PrefixCounter:
    """Counts for one sentencepiece BPE model, without begin, end or added tokens."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes_for_unknown = any(sp.is_byte(i) for i in range(n))
        if any(_MARK in piece.lstrip(_MARK) for piece in self.score):
            raise ValueError(f"{model_file}: a piece goes on after a white-space mark; its texts have no segments")
        joined = {c for piece in self.score if len(piece) > 1 for c in piece}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        self.segments = re.compile(f"{_MARK}+[^{_MARK}{alone}]*|[^{_MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, int] = {}
        self.tables: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.spines: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.pairs = {piece[i : i + 2] for piece in self.score for i in range(len(piece) - 1)}
        self.begun: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}
        self.backward: dict = {}  # the pieces by their characters from the last to the first
        for piece in self.score:
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        dummy = sp.encode("a", out_type=str)[0]
        self.prefix = _MARK if dummy.startswith(_MARK) else ""
        self._probe(sp, model_file)

    def _probe(self, sp: sentencepiece.SentencePieceProcessor, model_file: str) -> None:
        """Raises ValueError for a model that does more than these merges: that normalises texts, drops white space or has pieces of its user's."""
        own = [piece for piece, score in self.score.items() if score == 0][:100]  # what a user adds has no rank
        for text in (" a  b ", "\tA\r\n\nb\u3000c\xa0", "\ufb01 \uff21 \xe9 e\u0301 \u1100\u1161 \u200b\x00", "<s></s><unk><0x41>\u2581x", "x".join(own), " the of and to in 12345 \U0001f600"):
            if self.count(text) != len(sp.encode(text)):
                raise ValueError(f"{model_file}: not a plain byte-pair model; the library counts {text!r} otherwise")

    def cost(self, piece: str) -> int:
        """Tokens of one piece: a character outside the vocabulary falls back to its bytes."""
        return 1 if piece in self.score or not self.bytes_for_unknown else len(piece.encode("utf-8", "surrogatepass"))

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def spine(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """The parts that stand at the piece's right (or left) end while it is merged, shortest first, each with the score of the merge that ends it."""
        key = (piece, right)
        found = self.spines.get(key)
        if found is None:
            parts, found, before = list(piece), [], math.inf
            end = -1 if right else 0
            found.append((parts[end], -math.inf))
            while len(parts) > 1:
                best, at = max((self.score.get(parts[i] + parts[i + 1], -math.inf), -i) for i in range(len(parts) - 1))
                if best == -math.inf or best > before:
                    break
                before = best
                parts[-at : -at + 2] = [parts[-at] + parts[-at + 1]]
                if parts[end] != found[-1][0]:
                    found[-1] = (found[-1][0], best)
                    found.append((parts[end], -math.inf))
            if len(parts) > 1:
                found = []  # not a piece that the merges give, or one whose merges do not come in the order of their scores
            self.spines[key] = found
        return found

    def _fits(self, last: str, piece: str) -> bool:
        if not last:
            return self.merged(piece) == [piece]
        left, right = self.spine(last, True), self.spine(piece, False)
        if not left or not right:
            return last + piece not in self.score and self.merged(last + piece) == [last, piece]
        i = j = 0
        while True:  # the two ends as they change, in the order of the merges; of equal scores the left merge comes first
            (x, ends_x), (y, ends_y) = left[i], right[j]
            across = self.score.get(x + y)
            if across is not None and across > ends_x and across >= ends_y:
                return False
            if ends_x == -math.inf and ends_y == -math.inf:
                return True
            if ends_x >= ends_y:
                i += 1
            else:
                j += 1

    def follows(self, last: str, piece: str) -> bool:
        """Whether the two stay as they are when their text is tokenized; last may be empty."""
        if len(self.fits) > KEPT:
            self.fits.clear()
        found = self.fits[(last, piece)] = self._fits(last, piece)
        return found

    def segment(self, text: str) -> tuple[int, ...]:
        """Counts at the prefixes of 1, 2, ... characters of one segment."""
        table = self.tables.get(text)
        if table is None:
            table = self._segment(text)
            if len(self.tables) > KEPT_TABLES:
                self.tables.clear()
            if len(text) <= 256:
                self.tables[text] = table
        return table

    def _segment(self, text: str) -> tuple[int, ...]:
        """The table of one segment. A step looks back only, so the table of a longer text goes on from that of its beginning."""
        counts, lasts, at = [0], [""], 0
        for n in PREFIXES:
            if n < len(text) and (begun := self.begun.get(text[:n])):
                counts, lasts, at = [*begun[0]], [*begun[1]], n
                break
        fits, root = self.fits, self.backward
        for i in range(at + 1, len(text) + 1):
            ends = []
            node = root.get(text[i - 1])
            start = i - 1
            while node is not None:
                if "" in node:
                    ends.append((start, node[""]))
                start -= 1
                node = node.get(text[start]) if start >= 0 else None
            cost = 1
            if not ends or ends[0][0] != i - 1:  # a character that is no piece of its own
                ends.insert(0, (i - 1, text[i - 1]))
                cost = self.cost(text[i - 1])
            for start, piece in reversed(ends):  # longest first; one of them fits
                last = lasts[start]
                fit = fits.get((last, piece))
                if fit or fit is None and self.follows(last, piece):
                    counts.append(counts[start] + (cost if start == i - 1 else 1))
                    lasts.append(piece)
                    break
            if i in PREFIXES:
                if len(self.begun) > KEPT_TABLES:
                    self.begun.clear()
                self.begun[text[:i]] = (tuple(counts), tuple(lasts))
        return tuple(counts[1:])

    def _total(self, text: str) -> int:
        """Tokens of one segment. It falls apart where no piece has the two neighbouring characters."""
        pairs, known, total, at = self.pairs, self.known, 0, 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in pairs:
                part = text[at:i]
                n = known.get(part)
                if n is None:
                    n = self._segment(part)[-1]
                    if len(part) <= 64 and len(part) < len(text):
                        known[part] = n
                total, at = total + n, i
        return total

    def _parts(self, text: str) -> list[str]:
        return self.segments.findall(self.prefix + text.replace(" ", _MARK)) if text else []

    def count(self, text: str) -> int:
        """Tokens of the whole text: the table's last entry."""
        known, total = self.known, 0
        for part in self._parts(text):
            n = known.get(part)
            if n is None:
                if len(known) > KEPT:
                    known.clear()
                n = self._total(part)
                if len(part) <= 64:
                    known[part] = n
            total += n
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """The count at every prefix: entry k is that of text[:k]; entry 0 is 0."""
        out, base = [np.zeros(1, dtype=np.int32)], 0
        for part in self._parts(text):
            inside = self.segment(part)
            out.append(np.asarray(inside, dtype=np.int32) + base)
            base += inside[-1]
        counts = np.concatenate(out)
        return np.concatenate((counts[:1], counts[1 + len(self.prefix) :])) if text else counts

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most characters whose own tokenization has no more than `budget` tokens."""
        base = at = best = 0
        for part in self._parts(text):
            if base >= budget:
                break
            inside = self.segment(part)
            for k in range(len(inside), 0, -1):
                if base + inside[k - 1] <= budget:
                    best = at + k
                    break
            base += inside[-1]
            at += len(part)
        return max(0, best - len(self.prefix))


@functools.lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    """One counter for each model and worker process."""
    return PrefixCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) for each row of docs(doc_id, text).

    n_bytes: UTF-8 bytes. over_limit: n_tokens > limit. fit_chars: the longest prefix, in characters, of at most
    `limit` tokens. A null text counts as an empty one: 0 bytes, 0 tokens. Repeated rows and null ids are returned
    as they come; other columns are ignored; an empty table gives no rows.
    """
    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = counter(model_file)
        for texts in parts(batches):
            rows = []
            for text in texts:
                text = text or ""
                n = tokens.count(text)
                rows.append((len(text.encode("utf-8", "surrogatepass")), n, n > limit, len(text) if n <= limit else tokens.longest_prefix(text, limit)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select("doc_id", counted("text").alias("counted")).select("doc_id", "counted.*")


def prefix_tables(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, prefix_counts): the count at every prefix, so that any later cut or budget is a look-up.

    Entry k (from 0) is the count of the first k characters. A null or empty text has the one entry 0.
    """
    @F.pandas_udf("array<int>")
    def tables(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(model_file)
        for texts in parts(batches, 100):
            yield pd.Series([tokens.prefix_counts(text or "") for text in texts])

    return docs.select("doc_id", tables("text").alias("prefix_counts"))
