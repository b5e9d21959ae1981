"""Toxicity as ordered severity grades: a cumulative-link (proportional odds) regression over sparse word features.

P(grade > k) = logistic(w.x - t_k) with thresholds t_0 < t_1 < ...; the weights are shared by all thresholds. x has a 1
for each word, or beginning of one, of the vocabulary that the whole text holds. The output is the expected grade and each text's most
likely grade; a text is toxic if P(grade > 0) reaches TOXIC_FROM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sampling import bounded_sample
from graphloom.llm.batches import parts, slices
from graphloom.scratch import Scratch

#: Labelled rows a model is fitted on at most; rows of that sample that must hold a word of the vocabulary; the
#: chance that any word gets into it that tells nothing.
FIT_ROWS, LEAST_ROWS, CHANCE = 6000, 5, 0.3
#: Lengths of the beginnings of words that are features too, and the probability of a grade above 0 from which a text is toxic.
BEGINNINGS, TOXIC_FROM = (4, 5, 6), 0.3
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The features of the whole text: its distinct words (runs of letters, lower-cased), and the beginnings of the longer ones, so that inflected forms share what they have in common."""
    if not text:
        return set()
    found = set(_WORD.findall(text.lower()))
    return found.union(*({f"{w[:n]}-" for w in found if len(w) > n} for n in BEGINNINGS))


@dataclass
class SeverityModel:
    """weights: of each word; thresholds: ascending, one fewer than grades."""

    weights: dict[str, float]
    thresholds: list[float]

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each k."""
        get = self.weights.get
        score = math.fsum(get(w, 0.0) for w in words(text))
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, features: int, steps: int = 400, rate: float = 0.1, decay: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for sparse 0/1 rows (arrays of feature numbers) with grades 0..K-1, by Adam on all rows.

    Thresholds are a first one plus positive steps, so that they stay ordered. The slope is that of the weighted log-likelihood
    of P(grade) = P(> grade - 1) - P(> grade).
    """
    top = int(grades.max())
    at = np.concatenate(rows).astype(np.intp) if rows else np.empty(0, np.intp)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    params = np.zeros(features + top)
    share = weight / weight.sum()
    tail = [min(max(share[grades > k].sum(), 1e-3), 1 - 1e-3) for k in range(top)]
    params[features] = math.log((1 - tail[0]) / tail[0])
    for k in range(1, top):
        gap = math.log((1 - tail[k]) / tail[k]) - math.log((1 - tail[k - 1]) / tail[k - 1])
        params[features + k] = math.log(math.expm1(max(gap, 0.05)))
    m, v = np.zeros_like(params), np.zeros_like(params)
    soft = lambda z: np.logaddexp(0, z)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w, raw = params[:features], params[features:]
        thresholds = raw[0] + np.concatenate(([0], np.cumsum(soft(raw[1:]))))
        score = np.bincount(row, w[at], minlength=len(rows))
        over = np.hstack([np.ones((len(rows), 1)), sigmoid(score[:, None] - thresholds), np.zeros((len(rows), 1))])
        p = np.maximum(over[np.arange(len(rows)), grades] - over[np.arange(len(rows)), grades + 1], 1e-12)
        steep = over * (1 - over)
        hi, lo = steep[np.arange(len(rows)), grades], steep[np.arange(len(rows)), grades + 1]
        by_score = -share * (hi - lo) / p
        by_threshold = np.zeros(top)
        np.add.at(by_threshold, grades[grades > 0] - 1, (share * hi / p)[grades > 0])
        np.add.at(by_threshold, grades[grades < top], -(share * lo / p)[grades < top])
        g = np.empty_like(params)
        g[:features] = np.bincount(at, by_score[row], minlength=features) + decay * w
        later = np.cumsum(by_threshold[::-1])[::-1]
        g[features] = later[0]
        g[features + 1 :] = later[1:] * sigmoid(raw[1:])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    raw = params[features:]
    return params[:features], raw[0] + np.concatenate(([0], np.cumsum(soft(raw[1:]))))


def telling_words(held: DataFrame) -> list[str]:
    """The words that rows of higher grades hold so much more or less often than the lowest that chance would hardly pick one; held(grade, words).

    A word's log-likelihood ratio bounds the logarithm of its probability by chance (Chernoff); it is held against the number of words tried.
    """
    sums = held.groupBy("grade").count().collect()  # one row for each grade
    n = sum(r["count"] for r in sums)
    lowest = min((r["grade"] for r in sums), default=0)
    n1 = sum(r["count"] for r in sums if r["grade"] > lowest)
    if not n1 or n1 == n:
        return []
    counts = held.select((F.col("grade") > lowest).cast("int").alias("high"), F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.sum("high").alias("k1")).where(F.col("k") >= LEAST_ROWS)
    total = counts.count()
    part = lambda k, share: F.when(k > 0, k * F.ln(k / (F.col("k") * F.lit(share)))).otherwise(0.0)
    ratio = part(F.col("k1"), n1 / n) + part(F.col("k") - F.col("k1"), 1 - n1 / n)
    return sorted(r["word"] for r in counts.where(ratio >= math.log(max(total, 1) / CHANCE)).select("word").collect())


def fit_severity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> SeverityModel:
    """A model from docs(doc_id, text) and labels(doc_id, grade), fitted on about `most` labelled rows, whole texts.

    Grades are whole numbers from 0. Where there are two only, the rows of grade 1 that a first fit finds worst
    (above its median) become grade 2, so that severity has an order to learn. With fewer than two grades the model
    finds nothing toxic. Of labels that repeat an id the highest counts.
    """
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("grade >= 0")
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sample, totals = bounded_sample(graded, "grade", "doc_id", most)
    if len(totals) < 2:
        return SeverityModel({}, [40.0])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(words(t.as_py())) for t in batch.column(2)], pa.list_(pa.string()))], ["doc_id", "grade", "words"])

    scratch = Scratch(docs.sparkSession, "severity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")  # the sample is bounded by `most`
    held = joined.mapInArrow(hold, "doc_id long, grade int, words array<string>")
    one = F.min_by(F.struct("doc_id", "grade", "words"), F.col("doc_id")).alias("one")
    held = scratch.table(held.groupBy(F.xxhash64("words").alias("key")).agg(one).select("one.*"))  # copies teach nothing new
    vocabulary = {w: i for i, w in enumerate(telling_words(held))}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[vocabulary[w] for w in row.as_py() if w in vocabulary] for row in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "grade", "words"])

    found = held.mapInArrow(known, "doc_id long, grade int, words array<int>").toPandas().sort_values("doc_id", ignore_index=True)  # about `most` rows
    scratch.close()
    if not len(found):
        return SeverityModel({}, [40.0])
    rows = [np.asarray(ids, dtype=np.int64) for ids in found["words"]]
    levels = {g: i for i, g in enumerate(sorted(found["grade"].unique()))}
    if len(levels) < 2:
        return SeverityModel({}, [40.0])
    grades = found["grade"].map(levels).to_numpy(dtype=np.int64)
    taken = found["grade"].value_counts()
    weight = found["grade"].map(lambda g: totals[g] / taken[g]).to_numpy(dtype=float)
    w, thresholds = fit_cumulative_link(rows, grades, weight, len(vocabulary))
    if len(levels) == 2:
        score = np.array([w[r].sum() for r in rows])
        worst = (grades == 1) & (score > np.median(score[grades == 1]))
        if worst.any():
            w, thresholds = fit_cumulative_link(rows, grades + worst, weight, len(vocabulary))
    return SeverityModel({word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 1e-6}, [float(t) for t in thresholds])


def severity(docs: DataFrame, model: SeverityModel, column: str = "severity") -> DataFrame:
    """The docs with a struct column (grade, expected_severity, p_toxic, toxic) made from `text` alone, over whole texts.

    grade: the most likely grade. A null or empty text holds no word and gets what the thresholds alone give. Rows are
    returned as they come, with all their columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary from the bounded sample

    @F.pandas_udf("grade int, expected_severity double, p_toxic double, toxic boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in parts(batches):
            out = []
            for text in texts:
                over = [1.0, *known.above(text), 0.0]
                likely = max(range(len(over) - 1), key=lambda k: over[k] - over[k + 1])
                out.append((likely, math.fsum(over[1:]), over[1], over[1] >= TOXIC_FROM))
            yield pd.DataFrame(out, columns=["grade", "expected_severity", "p_toxic", "toxic"])

    return docs.withColumn(column, predict("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade, expected_severity, p_toxic, toxic) for each row of docs(doc_id, text); labels(doc_id, grade).

    Repeated rows and null ids are returned as they come; other columns are ignored; an empty table gives no rows.
    """
    model = fit_severity(docs, labels)
    return severity(docs.select("doc_id", "text"), model, "_severity").select("doc_id", "_severity.*")
