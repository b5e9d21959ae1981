"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed character n-grams (of the UTF-8
bytes of the lower-cased text) tells the languages with a 1 from those with a 0. Decoding takes the language whose
codeword has the least loss, each bit weighted by how well its classifier does on rows kept out of its fit; a
small distance to the second codeword flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sampling import bounded_sample
from graphloom.llm.batches import parts, slices

#: Hashed n-gram features; bytes of a text that are counted at once; labelled rows a model is fitted on at most.
FEATURES, PIECE, FIT_ROWS = 1 << 13, 1 << 20, 1500
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def ngram_features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 4-grams in the whole text: a unit vector of FEATURES floats."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    counts = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(raw), PIECE):
        codes = _FOLD[np.frombuffer(raw[at : at + PIECE + 3], dtype=np.uint8)]
        n = min(PIECE, len(codes))
        ids = codes
        for order in range(1, 5):
            if order > 1:
                ids = ids[: len(codes) - order + 1] * 1_000_003 + codes[order - 1 :]
            hashed = (ids * np.int64(0x9E3779B1) >> 13) & (FEATURES - 1)
            counts += np.bincount(hashed[:n], minlength=FEATURES)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: every split of up to 6 languages, else the best of many random codes of 10 log2 n bits."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 6:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(n)], dtype=np.int8)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * bits
        usable = (np.abs(code.sum(axis=0)) < n).all()
        if usable and (best is None or apart.min() > best[0]):
            best = (apart.min(), code)
    return best[1]


@dataclass
class LanguageModel:
    """languages; codes: a codeword for each; weights: FEATURES + 1 rows (the last is the bias) for each bit; trust: each bit's weight."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of features: the nearest language, its probability, and by how much it leads the second."""
        outputs = features @ self.weights[:-1] + self.weights[-1]
        losses = np.stack([(np.logaddexp(0, -outputs * code) * self.trust).sum(axis=1) for code in self.codes], axis=1)
        p = np.exp(losses.min(axis=1, keepdims=True) - losses)
        p /= p.sum(axis=1, keepdims=True)
        ranked = np.sort(p, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
        return losses.argmin(axis=1), ranked[:, -1], lead


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights of one logistic regression for each column of y (+1 or -1), by Adam on all rows."""
    w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w), -30, 30))) / len(x)
        g = x.T @ slope.astype(np.float32) + decay * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_language_model(labelled: DataFrame, most: int = FIT_ROWS) -> LanguageModel:
    """A model from labelled(doc_id, text, lang), fitted on a sample of about `most` rows, whole texts, balanced over languages.

    Without any labelled row the model knows no language and answers `und`.
    """
    rows = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull())
    sample, totals = bounded_sample(rows, "lang", "doc_id", most)
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((FEATURES + 1, 0), np.float32), np.zeros(0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [ngram_features(text.as_py()).astype(np.float16).tobytes() for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], ["doc_id", "lang", "features"])

    found = sample.select("doc_id", "lang", "text").mapInArrow(features, "doc_id long, lang string, features binary").toPandas()  # about `most` rows
    found = found.sort_values(["doc_id", "lang"], ignore_index=True)
    codes = codewords(len(languages))
    if not codes.shape[1] or not len(found):
        return LanguageModel(languages, codes[:, :0], np.zeros((FEATURES + 1, 0), np.float32), np.zeros(0))
    x = np.ones((len(found), FEATURES + 1), dtype=np.float32)
    for i, f in enumerate(found.pop("features")):
        x[i, :-1] = np.frombuffer(f, dtype=np.float16)
    y = codes[[languages.index(v) for v in found["lang"]]].astype(np.float32)
    check = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
    trust = np.ones(y.shape[1])
    if check.any():
        right = (np.sign(x[check] @ _logistic(x[~check], y[~check], steps=80)) == y[check]).mean(axis=0)
        trust = np.clip(2 * right - 1, 0.05, 1)
    return LanguageModel(languages, codes, _logistic(x, y), trust)


def identify(docs: DataFrame, model: LanguageModel, ambiguous_below: float = 0.2, column: str = "language") -> DataFrame:
    """The docs with a struct column (lang_pred, score, ambiguous) made from `text` alone, over whole texts.

    score: the probability of lang_pred, 0 to 1. A null text and one without any letter are `und` with score 0, and
    so is every text if the model knows no language. ambiguous: the second language is nearer than
    `ambiguous_below`, or the text is `und`. Rows are returned as they come, with all their columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits floats, whatever the input

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in parts(batches):
            names, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            for start in range(0, len(texts), 64):
                some = [i for i in range(start, min(start + 64, len(texts))) if known.languages and texts.iloc[i] and _LETTER.search(texts.iloc[i])]
                if some:
                    best, p, lead = known.decode(np.stack([ngram_features(texts.iloc[i]) for i in some]))
                    for i, b in zip(some, best, strict=True):
                        names[i] = known.languages[b]
                    scores[some], unsure[some] = p, lead < ambiguous_below
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": unsure})

    return docs.withColumn(column, predict("text"))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id is not one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for each row of docs(doc_id, text, lang).

    The model learns from text and lang of rows that are not held out and have a lang. lang, source and doc_id take no
    part in a prediction. Repeated rows and null ids are returned as they come; an empty table gives no rows.
    """
    model = fit_language_model(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model, column="_language")
    return out.select("doc_id", held_out().alias("held_out"), "_language.*")
