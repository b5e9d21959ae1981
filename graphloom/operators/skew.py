"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, and from this number of them; so there are HOT_SHARE hot keys at most.
HOT_SHARE, HOT_ROWS = 1000, 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows, `total` of them at most, with the facts of their key: one row for each key, whose column `count` says how many rows it has.

    Facts of the hot keys (HOT_SHARE at most) are broadcast and meet their rows wherever those lie; only the other rows are dealt by key.
    The column `count` is left out. Rows whose key has no facts fall away.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = facts.where(F.col(count) > limit).drop(count)
    names = [c for c in hot.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*names).alias("_hot"))), key, "left")
    met = marked.where("_hot IS NOT NULL").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in names))
    rest = marked.where("_hot IS NULL").drop("_hot").join(facts.where(F.col(count) <= limit).drop(count), key)
    return met.unionByName(rest.select(*met.columns))
