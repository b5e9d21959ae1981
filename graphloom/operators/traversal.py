"""Reasoning paths: hop scores, conductivity, beam search from many starts at once, queries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import Config
from graphloom.functions.vectors import TINY
from graphloom.operators.graph import Graph, neighbours, with_effective_weight
from graphloom.operators.similarity import anchors
from graphloom.session import held


#: A graph of up to so many hops and so many bytes of vectors is sent to the queries; beyond it queries and hops meet by joins.
LOCAL_HOPS, LOCAL_BYTES = 500_000, 64_000_000


def _no_nodes():
    return F.array().cast("array<string>")


def hop_scores(graph: Graph, deltas: DataFrame | None = None) -> DataFrame:
    """(src, dst, ord, score): effective weight times activation, recency and agreement of the target."""
    edges = with_effective_weight(graph.edges, deltas).select("src", "dst", "ord", "effective_weight")
    target = graph.nodes.select(F.col("node_id").alias("dst"), (F.col("activation") * F.col("recency") * F.col("agreement")).alias("_t"))
    return edges.join(target, "dst").select("src", "dst", "ord", (F.col("effective_weight") * F.col("_t")).alias("score"))


def path_conductivity(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """paths(path_id, node_ids) with conductivity and hop_scores: the geometric mean of the hops; 0 if a hop scores nothing or is missing, or if there is none."""
    hops = paths.select("path_id", F.posexplode(F.arrays_zip(F.expr("slice(node_ids, 1, greatest(size(node_ids) - 1, 0))").alias("src"), F.expr("slice(node_ids, 2, greatest(size(node_ids) - 1, 0))").alias("dst"))).alias("pos", "e"))
    found = hops.select("path_id", "pos", "e.src", "e.dst").join(scores.select("src", "dst", "score"), ["src", "dst"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_path = found.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("h"), F.min("score").alias("least"))
    scored = by_path.select("path_id", F.col("h.score").alias("hop_scores"), "least")
    log_sum = F.aggregate("hop_scores", F.lit(0.0), lambda s, x: s + F.ln(x))
    value = F.when(F.coalesce("least", F.lit(0.0)) <= 0, 0.0).otherwise(F.exp(log_sum / F.size("hop_scores")))
    return paths.join(scored, "path_id", "left").select(*paths.columns, value.alias("conductivity"), F.coalesce("hop_scores", F.array().cast("array<double>")).alias("hop_scores"))


def beam_search(starts: DataFrame, scores: DataFrame, config: Config = Config(), visited: DataFrame | None = None) -> DataFrame:
    """(query_id, node_ids, hop_scores, conductivity, place): the best paths from starts(query_id, node_id), all starts in step.

    At each depth every path of the beam is extended by all hops that score above nothing to nodes neither on the path nor
    visited(query_id, nodes); the `beam_width` best by mean logarithm stay. Paths that cannot go on, and the last beam, are the
    results. Ties go by the place of what is extended, then by the edge's place. A depth is one equi-join, in which ended paths find
    nothing and pass, and one ranked window; nothing is collected.
    """
    beam = starts.select("query_id", F.array("node_id").alias("path"), F.lit(0.0).alias("logs"), F.array().cast("array<double>").alias("hops"), F.lit(1).alias("pos"))
    if visited is not None:
        beam = beam.join(visited.select("query_id", F.col("nodes").alias("_seen")), "query_id", "left").withColumn("_seen", F.coalesce("_seen", _no_nodes()))
    else:
        beam = beam.withColumn("_seen", _no_nodes())
    hop = scores.where("score > 0").select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("ord").alias("_ord"), F.col("score").alias("_score"))
    out = beam.withColumn("ended", F.lit(None).cast("int"))
    for depth in range(1, config.max_path_depth + 1):
        # paths that ended pass through; those that find no hop end here
        open_to = F.col("ended").isNull() & (F.element_at("path", -1) == F.col("_src")) & ~F.array_contains("path", F.col("_dst")) & ~F.array_contains("_seen", F.col("_dst"))
        tried = out.join(hop, open_to, "left")
        went = F.col("_dst").isNotNull()
        ended = F.coalesce("ended", F.when(~went, F.lit(depth)))
        tried = tried.select(
            "query_id", F.when(went, F.concat("path", F.array("_dst"))).otherwise(F.col("path")).alias("path"), F.when(went, F.col("logs") + F.ln("_score")).otherwise(F.col("logs")).alias("logs"),
            F.when(went, F.concat("hops", F.array("_score"))).otherwise(F.col("hops")).alias("hops"), F.col("pos").alias("_parent"), "_ord", "_seen", ended.alias("ended"),
        ).where("size(hops) > 0")
        rank = F.row_number().over(Window.partitionBy("query_id", "_live").orderBy(F.desc(F.col("logs") / depth), "_parent", "_ord"))
        tried = tried.withColumn("_live", F.col("ended").isNull()).withColumn("_rank", rank)
        out = tried.where(~F.col("_live") | (F.col("_rank") <= config.beam_width)).select("query_id", "path", "logs", "hops", F.when(F.col("_live"), F.col("_rank")).otherwise(F.col("_parent")).alias("pos"), "_seen", "ended")
    out = out.withColumn("ended", F.coalesce("ended", F.lit(config.max_path_depth + 1)))
    value = F.exp(F.col("logs") / F.size("hops"))
    best = Window.partitionBy("query_id").orderBy(F.desc("conductivity"), "ended", "pos")
    out = out.withColumn("conductivity", value).withColumn("place", F.row_number().over(best)).where(F.col("place") <= config.top_k_paths)
    return out.select("query_id", F.col("path").alias("node_ids"), F.col("hops").alias("hop_scores"), "conductivity", "place")


def query_paths(graph: Graph, queries: DataFrame, config: Config = Config(), deltas: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, node_ids, labels, conductivity, hop_scores, length) for queries(query_id, vector): the best paths from their anchors.

    Anchors are searched in order of similarity; the nodes of paths found from one (but for each path's first) are closed
    to the later ones. Many queries run together. Where the graph has been measured to be small (a session's is, by its cap) it is broadcast and
    each task answers its share of the queries, with no shuffle; a larger graph is searched by joins, all queries in step.
    """
    local = local_graph(graph, deltas)
    if local is not None:
        return _paths_by_query(local, queries, config)
    return _paths_by_joins(graph, queries, held(hop_scores(graph, deltas)), config)


@dataclass(frozen=True)
class LocalGraph:
    """A graph that was measured to be small, in memory: nodes with a vector in order and their unit vectors, hops that score, all neighbours, labels."""

    ids: np.ndarray
    unit: np.ndarray
    hops: dict[str, list[tuple[str, float]]]
    near: dict[str, set[str]]
    labels: dict[str, str]

    def anchors(self, vector, k: int) -> list[str]:
        """The k nodes most similar to the vector, those of a negative similarity left out."""
        x = None if vector is None else np.asarray(vector, dtype=float)
        if x is None or not len(self.ids) or np.linalg.norm(x) < TINY:
            return []
        likeness = self.unit @ (x / np.linalg.norm(x))
        return [self.ids[i] for i in np.argsort(-likeness, kind="stable")[:k] if likeness[i] >= 0]

    def paths(self, vector, config: Config) -> list[tuple[list[str], list[float], float]]:
        """The best paths from a vector's anchors, best first: (nodes, hop scores, conductivity)."""
        found: dict[tuple[str, ...], tuple[list[str], list[float], float]] = {}
        closed: set[str] = set()
        for start in self.anchors(vector, config.top_k_anchors):
            for path, scored, value in _beam(start, self.hops, closed, config):
                found.setdefault(tuple(path), (path, scored, value))
            closed.update(node for path, _, _ in found.values() for node in path[1:])
        return sorted(found.values(), key=lambda p: -p[2])[: config.top_k_paths]


def local_graph(graph: Graph, deltas: DataFrame | None = None) -> LocalGraph | None:
    """The graph in memory, if it has LOCAL_HOPS edges and LOCAL_BYTES of vectors at most; else None."""
    nodes = graph.nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if nodes[0] > LOCAL_HOPS or nodes[0] * max(0, nodes[1]) * 8 > LOCAL_BYTES or graph.edges.limit(LOCAL_HOPS + 1).count() > LOCAL_HOPS:
        return None
    rows = graph.nodes.select("node_id", "label", "embedding", "ord").orderBy("ord").toPandas()  # measured to be small
    seen = rows[rows["embedding"].notna()]
    vectors = np.array(seen["embedding"].tolist(), dtype=float).reshape(len(seen), -1) if len(seen) else np.zeros((0, 0))
    lengths = np.linalg.norm(vectors, axis=1)
    keep = lengths >= TINY
    hops: dict[str, list[tuple[str, float]]] = {}
    for src, dst, score in hop_scores(graph, deltas).where("score > 0").orderBy("src", "ord").select("src", "dst", "score").toPandas().itertuples(index=False):
        hops.setdefault(src, []).append((dst, score))
    near: dict[str, set[str]] = {}
    for src, dst in graph.edges.select("src", "dst").toPandas().itertuples(index=False):
        near.setdefault(src, set()).add(dst)
        near.setdefault(dst, set()).add(src)
    return LocalGraph(seen["node_id"].to_numpy()[keep], vectors[keep] / lengths[keep, None], hops, near, dict(zip(rows["node_id"], rows["label"], strict=True)))


def _paths_by_query(local: LocalGraph, queries: DataFrame, config: Config) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(local)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = shared.value
        for batch in batches:
            out = []
            for query_id, vector in zip(batch["query_id"], batch["vector"], strict=True):
                for rank, (path, scored, value) in enumerate(local.paths(vector, config), 1):
                    out.append((query_id, rank, path, [local.labels.get(i) for i in path], value, scored, len(path)))
            yield pd.DataFrame(out, columns=["query_id", "rank", "node_ids", "labels", "conductivity", "hop_scores", "length"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "vector").mapInPandas(answer, f"query_id {kind}, rank int, node_ids array<string>, labels array<string>, conductivity double, hop_scores array<double>, length int")


def _beam(start: str, hops: dict, closed: set[str], config: Config) -> list[tuple[list[str], list[float], float]]:
    live, ended = [(0.0, [start], [])], []
    for depth in range(1, config.max_path_depth + 1):
        longer = []
        for logs, path, scored in live:
            on = [(logs + math.log(s), [*path, node], [*scored, s]) for node, s in hops.get(path[-1], ()) if node not in closed and node not in path]
            if on:
                longer += on
            elif scored:
                ended.append((logs, path, scored))
        live = sorted(longer, key=lambda p: -p[0] / depth)[: config.beam_width]
    best = [(path, scored, math.exp(logs / len(scored))) for logs, path, scored in ended + live]
    return sorted(best, key=lambda p: -p[2])[: config.top_k_paths]


def _paths_by_joins(graph: Graph, queries: DataFrame, scores: DataFrame, config: Config) -> DataFrame:
    picked = held(anchors(graph.nodes, queries, config.top_k_anchors))
    found, visited = None, None
    for place in range(1, config.top_k_anchors + 1):
        starts = picked.where(F.col("place") == place).select("query_id", "node_id")
        paths = held(beam_search(starts, scores, config, visited).withColumn("anchor", F.lit(place)))
        found = paths if found is None else found.unionByName(paths)
        visited = found.select("query_id", F.explode(F.expr("slice(node_ids, 2, size(node_ids) - 1)")).alias("n")).groupBy("query_id").agg(F.collect_set("n").alias("nodes"))
    once = found.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "node_ids").orderBy("anchor", "place"))).where("_nth = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("conductivity"), "anchor", "place"))
    best = once.withColumn("rank", rank).where(F.col("rank") <= config.top_k_paths)
    return with_labels(best, graph.nodes)


def with_labels(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths (query_id, rank, node_ids, conductivity, hop_scores) with their labels and length."""
    steps = paths.select("query_id", "rank", F.posexplode("node_ids").alias("i", "node_id")).join(nodes.select("node_id", "label"), "node_id", "left")
    labels = steps.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("l"))
    out = paths.join(labels.select("query_id", "rank", F.col("l.label").alias("labels")), ["query_id", "rank"])
    return out.select("query_id", "rank", "node_ids", "labels", "conductivity", "hop_scores", F.size("node_ids").alias("length"))


def protected_by(graph: Graph, picked: DataFrame) -> DataFrame:
    """(node_id): what a query protects: its anchors and their neighbours."""
    ids = picked.select("node_id").distinct()
    near = neighbours(graph.edges).join(ids.select(F.col("node_id").alias("id")), "id", "left_semi").select(F.col("other").alias("node_id"))
    return ids.unionByName(near).distinct()
