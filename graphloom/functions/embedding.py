"""Embedders: a deterministic stand-in from hashes, and a model's where its library is installed."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Anything that turns texts into rows of a matrix. It must be picklable."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors of normal numbers, seeded by the text's SHA-256. Equal texts agree, others are unrelated."""

    def __init__(self, size: int = 384):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.size))
        for i, text in enumerate(texts):
            seed = int(hashlib.sha256(text.strip().lower().encode("utf-8", "surrogatepass")).hexdigest(), 16) % 2**32
            out[i] = np.random.default_rng(seed).standard_normal(self.size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)


@lru_cache(maxsize=2)
def _model(name: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


class ModelEmbedder:
    """A sentence-transformers model, loaded once in each worker."""

    def __init__(self, name: str = "all-MiniLM-L6-v2"):
        self.name = name

    def encode(self, texts: list[str]) -> np.ndarray:
        return _model(self.name).encode(texts, normalize_embeddings=True, show_progress_bar=False)


def get_embedder(use_model: bool = False, name: str = "all-MiniLM-L6-v2") -> Embedder:
    """The model's embedder if it is asked for and can be loaded, else the stand-in."""
    if use_model:
        try:
            _model(name)
            return ModelEmbedder(name)
        except Exception as e:  # not installed, or the model cannot be loaded
            print(f"{name} cannot be loaded ({type(e).__name__}); texts get stand-in vectors", file=sys.stderr)
    return HashEmbedder()


def embed(text: Column, embedder: Embedder) -> Column:
    """array<double>; null for null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = [i for i, text in enumerate(texts) if text is not None]
            out: list = [None] * len(texts)
            if there:
                for i, v in zip(there, embedder.encode([texts.iloc[i] for i in there]), strict=True):
                    out[i] = np.asarray(v, dtype=float)
            yield pd.Series(out, dtype=object)

    return run(text)


def embed_labels(nodes: DataFrame, embedder: Embedder) -> DataFrame:
    """Nodes whose embedding is null get that of their label; each distinct label is encoded once."""
    labels = nodes.where("embedding IS NULL AND label IS NOT NULL").select("label").distinct()
    made = labels.select(F.col("label").alias("_label"), embed(F.col("label"), embedder).alias("_made"))
    out = nodes.join(made, nodes["label"] == made["_label"], "left").withColumn("embedding", F.coalesce("embedding", "_made"))
    return out.select(*nodes.columns)
