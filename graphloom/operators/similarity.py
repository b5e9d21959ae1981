"""Similarity search: nodes near a vector, patterns near nodes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.vectors import TINY, cosine, literal, norm
from graphloom.session import held

#: Bytes of vectors that a similarity join broadcasts at a time, and rows of either side that are multiplied at once.
BROADCAST_BYTES, BLOCK = 64_000_000, 1024


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a list column, which have one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def similar_nodes(nodes: DataFrame, vector: Sequence[float], threshold: float = 0.0, k: int = 10) -> DataFrame:
    """The k nodes most similar to the vector, at least `threshold`; ties in insertion order. Null and zero vectors are left out."""
    v = literal(vector)
    found = nodes.where(F.col("embedding").isNotNull()).withColumn("similarity", cosine(F.col("embedding"), v)).where((norm(F.col("embedding")) >= TINY) & (F.col("similarity") >= threshold))
    return found.orderBy(F.desc("similarity"), "ord").limit(k)


def anchors(nodes: DataFrame, queries: DataFrame, k: int = 3, threshold: float = 0.0) -> DataFrame:
    """(query_id, node_id, similarity, place) for queries(query_id, vector): each query's k most similar nodes."""
    left = nodes.select("node_id", "ord", F.col("embedding").alias("v"))
    pairs = similarity_join(queries.select("query_id", F.col("vector").alias("v")), left, threshold, "query_id", "node_id")
    pairs = pairs.join(left.select("node_id", "ord"), "node_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "ord"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select("query_id", "node_id", "similarity", "place")


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, left_id: str, right_id: str, below: float | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of left(left_id, v) and right(right_id, v) with cosine >= threshold (or, with `below`, strictly between the two).

    The left side streams past the right one, which is measured first. If its vectors are larger than BROADCAST_BYTES, they are broadcast in slices
    of about that size, one after the other, each dropped after its pass over the left side; nothing is shuffled. A batch's products are made
    together, and only the pairs that pass are emitted. Null and zero vectors match nothing, nor do vectors of another length.
    """
    left, right = (_measurable(f, i) for f, i in ((left, left_id), (right, right_id)))
    schema = f"{left_id} {dict(left.dtypes)[left_id]}, {right_id} {dict(right.dtypes)[right_id]}, similarity double"

    def pairs(of_length: Callable[[int], tuple[pa.Array, np.ndarray] | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, x in _blocks(batches, left_id):
            if of_length(n) is None:
                continue
            others, unit = of_length(n)
            for at in range(0, len(others), BLOCK):
                score = x @ unit[at : at + BLOCK].T
                i, j = np.nonzero(score >= threshold if below is None else (score > threshold) & (score < below))
                if len(i):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), others.take(pa.array(j + at)), pa.array(score[i, j])], [left_id, right_id, "similarity"])

    return _past_slices(left, right, right_id, pairs, schema)


def linking_forest(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between left(a, v) and right(b, v) that connect the same ids as all pairs with cosine >= threshold do, but few of them.

    The similarity join with what a task has linked already left out: a task keeps a disjoint-set forest over the right side and its rows, emits a
    link only where it joins two trees, and skips blocks that lie in one tree. So a task emits fewer links than it has rows on both sides,
    however alike they are. An id that is on both sides is one vertex.
    """
    left, right = _measurable(left, "a"), _measurable(right, "b")

    def links(of_length: Callable[[int], tuple[pa.Array, np.ndarray] | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents: dict[int, np.ndarray] = {}
        for ids, n, x in _blocks(batches, "a"):
            if of_length(n) is None:
                continue
            others, unit = of_length(n)
            held = parents.get(n, np.arange(len(others)))
            parent = np.concatenate([held, np.arange(len(held), len(held) + len(ids))])  # the batch's rows last
            name = pa.concat_arrays([others, ids])
            own = pc.index_in(ids, value_set=others).fill_null(-1).to_numpy(zero_copy_only=False)
            own = np.where(own < 0, len(others) + np.arange(len(ids)), own)
            found: list[tuple[int, int]] = []
            for at in range(0, len(others), BLOCK):
                theirs = np.arange(at, min(at + BLOCK, len(others)))
                trees = _roots(parent, np.concatenate([theirs, own]))
                if (trees == trees[0]).all():
                    continue
                hit = x @ unit[at : at + BLOCK].T >= threshold
                for i in np.flatnonzero(hit.any(axis=1)):
                    met = np.unique(_roots(parent, np.append(theirs[hit[i]], own[i])))
                    parent[met] = met[0]
                    found += [(k, met[0]) for k in met[1:]]
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([name.take(pa.array(a)), name.take(pa.array(b))], ["a", "b"])
            parents[n] = parent[: len(others)].copy()  # a tree's root is its least vertex, so the batch's rows are nobody's parents

    return _past_slices(left, right, "b", links, "a string, b string").where("a != b")


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The trees of these vertices, whose paths are made short."""
    root = parent[of]
    while (root != (above := parent[root])).any():
        root = above
    parent[of] = root
    return root


def _measurable(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose vector has a direction, written once."""
    return held(rows.where(F.col("v").isNotNull() & (norm(F.col("v")) >= TINY)).select(name, F.col("v").cast("array<double>").alias("v")))


def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(ids, length, unit vectors) of at most BLOCK rows whose vectors have one length."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes):
            own = batch.filter(pa.array(sizes == n))
            for start in range(0, own.num_rows, BLOCK):
                some = own.slice(start, BLOCK)
                x = _matrix(some.column("v"))
                yield some.column(name), int(n), x / np.linalg.norm(x, axis=1, keepdims=True)


def _past_slices(left: DataFrame, right: DataFrame, right_id: str, stream: Callable, schema: str) -> DataFrame:
    """What `stream` makes of the left side's batches and of the right side's ids and unit vectors by length, which are broadcast in slices."""
    spark = left.sparkSession
    rows, longest = right.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()

    def passing(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        """The result of one slice of the right side, which its caller has bounded."""
        table = part.toArrow()
        by_length = {}
        sizes = pc.list_value_length(table.column("v")).to_numpy()
        for n in np.unique(sizes):
            own = table.filter(pa.array(sizes == n))
            x = _matrix(own.column("v"))
            by_length[int(n)] = (own.column(right_id).combine_chunks(), x / np.linalg.norm(x, axis=1, keepdims=True))
        shared = spark.sparkContext.broadcast(by_length)
        return left.mapInArrow(lambda batches: stream(lambda n: shared.value.get(n), batches), schema), shared

    slices = max(1, -(-rows * longest * 8 // BROADCAST_BYTES))
    if slices == 1:
        return passing(right)[0]
    found = []
    for k in range(slices):
        out, shared = passing(right.where(F.pmod(F.xxhash64(right_id), F.lit(slices)) == k))
        found.append(held(out))
        shared.destroy()
    return functools.reduce(DataFrame.unionByName, found)


def window_edges(vectors: DataFrame, threshold: float, low: int = 2, high: int = 5) -> DataFrame:
    """Band join: (doc, src, dst, similarity) of items `low` to `high` places apart in one document with cosine >= threshold.

    vectors(doc, pos, id, v). Each item looks ahead by window functions, one sort for each document's items, no self-join.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    ahead = F.array(*(F.struct(F.lead("id", n).over(order).alias("id"), F.lead("v", n).over(order).alias("v"), F.lit(n).alias("apart")) for n in range(low, high + 1)))
    pairs = vectors.withColumn("_ahead", ahead).select("doc", F.col("id").alias("src"), "v", F.explode("_ahead").alias("o")).where(F.col("o.id").isNotNull())
    return pairs.select("doc", "src", F.col("o.id").alias("dst"), F.col("o.apart").alias("apart"), cosine(F.col("v"), F.col("o.v")).alias("similarity")).where(F.col("similarity") >= threshold)
