"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample: k-means splits a node's vectors into BRANCHES children until a leaf is small
enough for its share of the whole table. Every row is then dealt to its leaf. A query walks the tree with a
priority queue: the node whose centre has the largest inner product with it is opened first, which puts all
leaves in an order of its own. How many of them it must visit is calibrated: true neighbours of a sample of queries are found by
brute force in blocks, and the visits are widened until the recall asked for is reached. Visited leaves are compared with
the queries that visit them in blocks of bounded size; scores are exact, in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.batches import slices
from graphloom.scratch import Scratch

#: Vectors the tree is fitted on, and queries it is calibrated with, at most.
FIT_ROWS, CALIBRATION_QUERIES = 20_000, 200
#: Children of a node, vectors of a leaf aimed at, leaves at most (the tree is broadcast).
BRANCHES, LEAF_ROWS, MOST_LEAVES = 8, 200, 4096
#: Vectors and queries of one block, and queries that are multiplied with a block's vectors at once.
BLOCK_ROWS, BLOCK_QUERIES, TOGETHER = 4096, 4096, 512


@dataclass
class Tree:
    """centres: one for each node; children: the nodes below each (none for a leaf); leaf: number of each leaf node, -1 for others."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree by the nearest centre."""
        out = np.zeros(len(vectors), dtype=np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[below]
                near = (np.einsum("ij,ij->i", c, c)[None, :] - 2 * vectors[rows] @ c.T).argmin(axis=1)
                stack += [(child, rows[near == i]) for i, child in enumerate(below)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves that best-bin-first traversal reaches."""
        product = self.centres @ query
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(queue, (-float(product[child]), child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for i in range(k):
            if (near == i).any():
                centres[i] = x[near == i].mean(axis=0)
    return centres


def fit_tree(sample: np.ndarray, rows: int, seed: int = 3) -> Tree:
    """A tree for `rows` rows of which `sample` is a sample."""
    rng = np.random.default_rng(seed)
    leaves = min(MOST_LEAVES, max(1, rows // LEAF_ROWS))
    least = max(2 * BRANCHES, len(sample) / leaves)
    centres, children, open_ = [sample.mean(axis=0) if len(sample) else np.zeros(0)], [[]], [(0, np.arange(len(sample)))]
    while open_:
        node, members = open_.pop()
        if len(members) <= least:
            continue
        c = _kmeans(sample[members], BRANCHES, rng)
        near = (np.einsum("ij,ij->i", c, c)[None, :] - 2 * sample[members] @ c.T).argmin(axis=1)
        sizes = np.bincount(near, minlength=BRANCHES)
        if (sizes > 0).sum() < 2:
            continue
        for i in np.flatnonzero(sizes):
            children[node].append(len(centres))
            open_.append((len(centres), members[near == i]))
            centres.append(c[i])
            children.append([])
    leaf, walk, n = np.full(len(centres), -1, dtype=np.int64), [0], 0
    while walk:  # leaves are numbered from left to right, so that neighbours in number are neighbours in the tree
        node = walk.pop()
        if children[node]:
            walk += children[node][::-1]
        else:
            leaf[node], n = n, n + 1
    return Tree(np.array(centres), children, leaf)


def _best(scores: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's place, score) of each query's k best: largest score, then smallest id; -inf takes no part.

    `scores` are products of matrices, right but for rounding: whatever may reach the k-th place within that error is scored again, summed
    in one fixed way, so that equal vectors have equal scores wherever they lie and no tie is lost.
    """
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    slack = 4 * vectors.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0.0)
    i, j = np.nonzero((scores >= (edge - 2 * slack)[:, None]) & (scores > -np.inf))
    exact = np.concatenate([(vectors[j[at : at + 65_536]] * queries[i[at : at + 65_536]]).sum(axis=1) for at in range(0, len(i), 65_536)] or [np.empty(0)])
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], exact[place < k]


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each leaf, blocks of each group): neighbouring leaves together up to BLOCK_ROWS rows; a larger leaf is a group of several blocks."""
    group, blocks, held = np.zeros(len(counts), dtype=np.int64), [0], 0
    for leaf, n in enumerate(counts):
        if held and held + n > BLOCK_ROWS:
            blocks.append(0)
            held = 0
        group[leaf] = len(blocks) - 1
        held += int(n)
        blocks[-1] = max(1, -(-held // BLOCK_ROWS))
    return group, np.array(blocks)


def _compare(placed: DataFrame, asks: DataFrame, tree: Tree, visits: int, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, rep, score): each query's k + 1 best classes in each block of a group of leaves of which it visits some.

    placed(rep, v, leaf) and asks(query_id, q). Groups, blocks of a large group and blocks of queries are of bounded size. A block
    holds the rows of all its leaves and looks, for each query, at those of the leaves that the query visits.
    """
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for leaf, n in placed.groupBy("leaf").count().collect():  # MOST_LEAVES rows or little more
        counts[leaf] = n
    group, blocks = _blocks(counts)
    shared = placed.sparkSession.sparkContext.broadcast((tree, group))

    @F.pandas_udf("array<struct<grp: long, leaves: array<int>>>")
    def groups_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree, group = shared.value
        for queries in batches:
            out = []
            for q in queries:
                held: dict[int, list[int]] = {}
                for leaf in tree.visits(np.asarray(q), visits):
                    held.setdefault(int(group[leaf]), []).append(leaf)
                out.append([{"grp": g, "leaves": leaves} for g, leaves in held.items()])
            yield pd.Series(out, dtype=object)

    where = placed.sparkSession.createDataFrame([(leaf, int(g), int(blocks[g])) for leaf, g in enumerate(group)], "leaf int, grp long, nv int")
    q = scratch.table(asks.select("query_id", "q", F.explode(groups_of("q")).alias("g")).select("query_id", "q", "g.*"))
    asked = q.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("nq"))
    sizes = scratch.table(where.select("grp", "nv").distinct().join(asked, "grp"))
    v = placed.join(where.select("leaf", "grp"), "leaf").join(sizes, "grp").select("grp", F.pmod(F.xxhash64("rep"), "nv").cast("int").alias("bv"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), F.col("rep").alias("id"), F.col("v").alias("x"), F.array(F.col("leaf").cast("int")).alias("leaves"), F.lit(False).alias("ask"))
    q = q.join(sizes, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv"), F.pmod(F.xxhash64("query_id"), "nq").cast("int").alias("bq"), F.col("query_id").alias("id"), F.col("q").alias("x"), "leaves", F.lit(True).alias("ask"))

    def run(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy()
        ids, x = table.column("id").to_numpy(), _stack(table.column("x"))
        lists = table.column("leaves").combine_chunks()
        values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows, asked = np.flatnonzero(~ask), np.flatnonzero(ask)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(rows):
            reps, vectors, leaf = ids[rows], x[rows], values[starts[rows]]
            low, high = int(leaf.min()), int(leaf.max())
            for at in range(0, len(asked), TOGETHER):
                some = asked[at : at + TOGETHER]
                wanted = np.concatenate([values[starts[i] : starts[i + 1]] for i in some])
                who = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
                here = (wanted >= low) & (wanted <= high)
                visited = np.zeros((len(some), high - low + 1), dtype=bool)
                visited[who[here], wanted[here] - low] = True
                scores = np.where(visited[:, leaf - low], x[some] @ vectors.T, -np.inf)
                i, j, score = _best(scores, x[some], vectors, reps, k + 1)
                found.append((ids[some[i]], reps[j], score))
        a, b, c = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(a, pa.int64()), "rep": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return v.unionByName(q).groupBy("grp", "bv", "bq").applyInArrow(run, "query_id long, rep long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors(vec_id, embedding): the k nearest of each row whose vec_id is divisible by `query_every`.

    Nearness is the inner product; a query is no neighbour of itself; ties go to the smaller vec_id. Every row is
    indexed; about `recall` of the true neighbours are found, measured by brute force on a sample of queries. Vectors that are null, zero, of
    another length than most, or hold a null or non-finite component take no part, nor do rows without vec_id; of rows that repeat a vec_id
    the least vector counts. With fewer candidates than k all are returned. Equal vectors form a class that is indexed once
    and stands for its k + 1 smallest ids. An empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    x = F.col("embedding").cast("array<double>")
    sound = F.size(x) > 0
    sound &= ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    rows = scratch.table(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        scratch.close()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held, rows = rows, rows.where(F.size("v") == lengths[0]["n"])
    # a class for each distinct vector, found by 128 bits of it; the rank limit keeps a hot class small before it is shuffled
    named = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit("again")).alias("h2"))
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = scratch.table(first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")).drop("h1", "h2"))
    asks = scratch.table(rows.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    scratch.drop(held)
    n = classes.count()
    part = lambda key, most, of: F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, of)))
    sample = classes.where(part("rep", FIT_ROWS, n)).select("rep", "v").toPandas().sort_values("rep")  # about FIT_ROWS rows
    tree = fit_tree(np.stack(sample["v"]) if len(sample) else np.zeros((0, lengths[0]["n"])), n)
    shared = spark.sparkContext.broadcast(tree)  # MOST_LEAVES leaves and their parents at most

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.assign(np.stack(v))) if len(v) else pd.Series([], dtype="int32")

    placed = scratch.table(classes.select("rep", "v", leaf_of("v").alias("leaf")))
    visits = _calibrate(placed, asks, tree, part, k, recall)

    best = scratch.table(_top(_compare(placed, asks, tree, visits, k, scratch), k + 1).select("query_id", "rep", "score"))
    for frame in (best, classes):
        scratch.keep(frame)
    scratch.close()
    members = best.join(classes.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(placed: DataFrame, asks: DataFrame, tree: Tree, part, k: int, recall: float) -> int:
    """Leaves to visit: the smallest power-of-1.25 number that finds `recall` of the sampled queries' true neighbours, themselves left out."""
    if tree.leaves <= 1:
        return 1
    queries = asks.where(part("query_id", CALIBRATION_QUERIES, asks.count())).select("query_id", "q").toPandas().sort_values("query_id")
    if not len(queries):
        return tree.leaves
    ids, q = queries["query_id"].to_numpy(), np.stack(queries["q"])
    shared = placed.sparkSession.sparkContext.broadcast((ids, q))  # about CALIBRATION_QUERIES vectors

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in slices(batches, BLOCK_ROWS):
            reps, leaf, vectors = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _stack(batch.column(1))
            i, j, score = _best(q @ vectors.T, q, vectors, reps, k + 1)
            other = (vectors[j] != q[i]).any(axis=1)  # a query and its equals lie in its own leaf and say nothing of the others
            i, j, score = i[other], j[other], score[other]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(reps[j], pa.int64()), pa.array(score, pa.float64()), pa.array(leaf[j], pa.int32())], ["query_id", "rep", "score", "leaf"])

    truth = _top(placed.select("rep", "v", "leaf").mapInArrow(scan, "query_id long, rep long, score double, leaf int"), k).toPandas()  # k rows for each sampled query
    if not len(truth):
        return tree.leaves
    where = {query_id: np.argsort(tree.visits(vector, tree.leaves)) for query_id, vector in zip(ids, q, strict=True)}
    needed = np.sort([where[a][b] + 1 for a, b in zip(truth["query_id"], truth["leaf"], strict=True)])
    visits = 1
    while (needed <= visits).mean() < recall:
        visits = max(visits + 1, int(visits * 1.25))
    return min(visits, tree.leaves)
