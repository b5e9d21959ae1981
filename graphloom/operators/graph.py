"""The concept graph: tables of nodes and edges, keyed by label, built and changed by whole-table operators."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import EDGE_TYPE_WEIGHTS
from graphloom.functions.texts import label_key
from graphloom.session import held

#: Edges of a graph that is broadcast for its betweenness at most; and sources of paths in a larger one.
LOCAL_EDGES, PIVOTS = 500_000, 64


@dataclass(frozen=True)
class Graph:
    """nodes and edges as in schemas.NODES and schemas.EDGES; at most one edge for a pair, none from a node to itself."""

    nodes: DataFrame
    edges: DataFrame


def type_weight(edge_type: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in EDGE_TYPE_WEIGHTS.items() for x in pair))[edge_type]


def merge_labels(nodes: DataFrame) -> DataFrame:
    """One node for each label: id, type and recency of the first, the highest activation and agreement, protected if any is, the first embedding there is."""
    keyed = nodes.withColumn("label", label_key(F.col("label")))
    first = F.min_by(F.struct("node_id", "node_type", "recency"), "ord")
    merged = keyed.groupBy("label").agg(
        first.alias("f"), F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("ord"))).alias("embedding"),
        F.max("activation").alias("activation"), F.bool_or("protected").alias("protected"), F.max("agreement").alias("agreement"), F.min("ord").alias("ord"),
    )
    return merged.select("f.node_id", "label", "embedding", "activation", "protected", "f.node_type", "agreement", "f.recency", "ord")


def canonical_ids(nodes: DataFrame) -> DataFrame:
    """(old_id, new_id): each node and the node that its label was merged into."""
    keyed = nodes.select(F.col("node_id").alias("old_id"), label_key(F.col("label")).alias("label"), "ord")
    first = keyed.groupBy("label").agg(F.min_by("old_id", "ord").alias("new_id"))
    return keyed.join(first, "label").groupBy("old_id").agg(F.min_by("new_id", "ord").alias("new_id"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair: the last one's values at the first one's place. A null weight takes the type's."""
    last = F.max_by(F.struct("edge_type", "base_weight", "agreement"), "ord")
    merged = edges.groupBy("src", "dst").agg(last.alias("e"), F.min("ord").alias("ord"))
    weight = F.coalesce("e.base_weight", type_weight(F.col("e.edge_type")))
    return merged.select("src", "dst", "e.edge_type", weight.alias("base_weight"), "e.agreement", "ord")


def remap_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between the merged nodes. Those of unknown nodes and those from a node to itself fall away."""
    a = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("_a"))
    b = ids.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_b"))
    out = edges.join(a, "src").join(b, "dst").where("_a != _b")
    return out.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "edge_type", "base_weight", "agreement", "ord")


def build_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    return Graph(merge_labels(nodes), merge_edges(remap_edges(edges, canonical_ids(nodes))))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other): both directions."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))


def edges_from(graph: Graph, ids: DataFrame) -> DataFrame:
    return graph.edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").select(*graph.edges.columns)


def edges_to(graph: Graph, ids: DataFrame) -> DataFrame:
    return graph.edges.join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)


def get_node(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("node_id") == node_id)


def get_node_by_label(graph: Graph, label: str) -> DataFrame:
    return graph.nodes.where(F.col("label") == label.strip().lower())


def get_edge(graph: Graph, src: str, dst: str) -> DataFrame:
    return graph.edges.where((F.col("src") == src) & (F.col("dst") == dst))


def node_labels(graph: Graph) -> DataFrame:
    return graph.nodes.select("label").distinct()


def degrees(graph: Graph) -> DataFrame:
    """(node_id, degree): edges in and out, 0 for a node without any."""
    ends = neighbours(graph.edges).groupBy(F.col("id").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_distribution(graph: Graph) -> DataFrame:
    """One row: the sorted degrees as array<double>; [0.0] for an empty graph. The graph is one session's, of bounded size."""
    found = degrees(graph).agg(F.array_sort(F.collect_list(F.col("degree").cast("double"))).alias("degrees"))
    return found.select(F.when(F.size("degrees") > 0, F.col("degrees")).otherwise(F.array(F.lit(0.0))).alias("degrees"))


def remove_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without these nodes and the edges that touch them."""
    ids = ids.select("node_id")
    edges = graph.edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_anti").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return Graph(graph.nodes.join(ids, "node_id", "left_anti").select(*graph.nodes.columns), edges.select(*graph.edges.columns))


def protect_around(graph: Graph, anchors: DataFrame) -> Graph:
    """The anchors and their neighbours on either side become protected."""
    ids = anchors.select("node_id")
    near = neighbours(graph.edges).join(ids.select(F.col("node_id").alias("id")), "id", "left_semi").select(F.col("other").alias("_hit"))
    hit = near.unionByName(ids.select(F.col("node_id").alias("_hit"))).distinct()
    nodes = graph.nodes.join(hit, graph.nodes["node_id"] == hit["_hit"], "left").withColumn("protected", F.coalesce("protected", F.lit(False)) | F.col("_hit").isNotNull())
    return Graph(nodes.select(*graph.nodes.columns), graph.edges)


def effective_weight(base: Column, delta: Column) -> Column:
    return F.greatest(F.lit(0.0), base * (1.0 + F.coalesce(delta, F.lit(0.0))))


def with_effective_weight(edges: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Edges with effective_weight: the base weight under the sum of all active changes of the edge."""
    if deltas is None:
        return edges.withColumn("effective_weight", F.greatest(F.lit(0.0), F.col("base_weight")))
    sums = deltas.groupBy("src", "dst").agg(F.sum("delta").alias("_delta"))
    return edges.join(sums, ["src", "dst"], "left").withColumn("effective_weight", effective_weight(F.col("base_weight"), F.col("_delta"))).drop("_delta").select(*edges.columns, "effective_weight")


def summary(graph: Graph, deltas: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, protected nodes, edges with an active change. Partial counts of three tables meet in one aggregation."""
    none = F.lit(0).cast("long")
    parts = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("protected").alias("protected")).select("nodes", none.alias("edges"), "protected", none.alias("sem_active"))
    parts = parts.unionByName(graph.edges.agg(F.count(F.lit(1)).alias("edges")).select(none.alias("nodes"), "edges", none.alias("protected"), none.alias("sem_active")))
    if deltas is not None:
        changed = graph.edges.join(deltas.select("src", "dst").distinct(), ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("sem_active"))
        parts = parts.unionByName(changed.select(none.alias("nodes"), none.alias("edges"), none.alias("protected"), "sem_active"))
    return parts.agg(*(F.sum(c).alias(c) for c in ("nodes", "edges", "protected", "sem_active")))


def betweenness(graph: Graph, as_distance: str = "weight", tasks: int = 8) -> DataFrame:
    """(node_id, betweenness): shortest-path betweenness, directed, normalised by (n - 1)(n - 2); 0 with two nodes or fewer.

    as_distance 'weight' takes the effective weight as a path's cost, so that strong edges are long; 'inverse' takes its
    reciprocal. Edges without weight are not gone along. The edges are measured first: up to LOCAL_EDGES of them are broadcast and
    sources are spread over tasks, each of which adds up its share. A larger graph stays in tables: paths from all sources (beyond PIVOTS
    nodes from so many of them, chosen by a hash, whose sums are scaled up) grow in step by joins.
    """
    cost = F.col("effective_weight") if as_distance == "weight" else 1.0 / F.col("effective_weight")
    edges = with_effective_weight(graph.edges) if "effective_weight" not in graph.edges.columns else graph.edges
    hops = held(edges.where("effective_weight > 0").select("src", "dst", cost.alias("c")))
    n = graph.nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if hops.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        parts = _local_parts(graph.nodes, hops, tasks)
    else:
        pivots = held(graph.nodes.select("node_id").orderBy(F.xxhash64("node_id")).limit(PIVOTS))
        parts = _parts_by_joins(pivots, hops)
        scale *= n / min(n, PIVOTS)
    sums = parts.groupBy("node_id").agg((F.sum("part") * F.lit(scale)).alias("betweenness"))
    return graph.nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _local_parts(nodes: DataFrame, hops: DataFrame, tasks: int) -> DataFrame:
    """(node_id, part): each task's sum of what its sources' shortest paths give a node."""
    out: dict[str, list[tuple[str, float]]] = {}
    for s, d, c in hops.toPandas().itertuples(index=False):  # measured to be few
        out.setdefault(s, []).append((d, c))
    shared = nodes.sparkSession.sparkContext.broadcast(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, float] = {}
        for batch in batches:
            for source in batch["node_id"]:
                for node, x in _dependencies(shared.value, source).items():
                    total[node] = total.get(node, 0.0) + x
        yield pd.DataFrame({"node_id": list(total), "part": list(total.values())}, columns=["node_id", "part"]).astype({"node_id": object, "part": float})

    return nodes.select("node_id").repartition(tasks, "node_id").mapInPandas(run, "node_id string, part double")


def _parts_by_joins(pivots: DataFrame, hops: DataFrame) -> DataFrame:
    """(node_id, part): what each pivot's shortest paths give a node, by tables of (source, node).

    A round lengthens the paths that got shorter by one hop. Shortest paths have no more hops than there are rounds, so as many rounds
    of sums along the edges on shortest paths count the paths, forwards, and add up the dependencies, backwards.
    """
    far = held(pivots.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0.0).alias("d")))
    edge, front, rounds = hops.select(F.col("src").alias("node"), F.col("dst").alias("next"), "c"), far, 0
    while not front.isEmpty():
        tried = front.join(edge, "node").groupBy("source", F.col("next").alias("node")).agg(F.min(F.col("d") + F.col("c")).alias("by"))
        both = held(far.join(tried, ["source", "node"], "full").withColumn("nearer", F.coalesce(F.col("by") < F.col("d") - 1e-12, F.col("by").isNotNull())))
        far = both.select("source", "node", F.when(F.col("nearer"), F.col("by")).otherwise(F.col("d")).alias("d"))
        front = far.join(both.where("nearer").select("source", "node"), ["source", "node"], "left_semi")
        rounds += 1
    far = held(far)
    to = far.select("source", F.col("node").alias("next"), F.col("d").alias("_d"))
    tight = held(far.join(edge, "node").join(to, ["source", "next"]).where(F.abs(F.col("d") + F.col("c") - F.col("_d")) <= 1e-12).select("source", "node", "next"))
    start = far.where("source = node").select("source", "node", F.lit(1.0).alias("paths"))
    counts = start
    for _ in range(rounds):
        more = counts.join(tight, ["source", "node"]).groupBy("source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        counts = held(start.unionByName(more))
    ways = counts.select("source", F.col("node").alias("next"), F.col("paths").alias("_paths"))
    share = held(tight.join(counts, ["source", "node"]).join(ways, ["source", "next"]).select("source", "node", "next", (F.col("paths") / F.col("_paths")).alias("share")))
    gains = far.select("source", "node", F.lit(0.0).alias("part"))
    for _ in range(rounds):
        after = gains.select("source", F.col("node").alias("next"), "part")
        gains = held(share.join(after, ["source", "next"], "left").groupBy("source", "node").agg(F.sum(F.col("share") * (1.0 + F.coalesce("part", F.lit(0.0)))).alias("part")))
    return gains.where("source != node").select(F.col("node").alias("node_id"), "part")


def _dependencies(out: dict[str, list[tuple[str, float]]], source: str) -> dict[str, float]:
    """How much each other node lies on the shortest paths from one source (Brandes, 2001)."""
    distance, count, before, done = {source: 0.0}, {source: 1.0}, {source: []}, []
    queue, closed = [(0.0, 0, source)], set()
    ticket = 0
    while queue:
        d, _, v = heapq.heappop(queue)
        if v in closed:
            continue
        closed.add(v)
        done.append(v)
        for w, cost in out.get(v, ()):
            through = d + cost
            if w in closed:
                continue
            if w not in distance or through < distance[w] - 1e-12:
                distance[w], count[w], before[w] = through, count[v], [v]
                ticket += 1
                heapq.heappush(queue, (through, ticket, w))
            elif abs(through - distance[w]) <= 1e-12:
                count[w] += count[v]
                before[w].append(v)
    share = dict.fromkeys(done, 0.0)
    for w in reversed(done):
        for v in before[w]:
            share[v] += count[v] / count[w] * (1.0 + share[w])
    share.pop(source)
    return share


def prune(graph: Graph, max_nodes: int, centrality: DataFrame | None = None) -> Graph:
    """At most max_nodes nodes: of those not protected the least central go first, in insertion order where they tie. Fewer go if too many are protected."""
    over = graph.nodes.count() - max_nodes
    if over <= 0:
        return graph
    centrality = betweenness(graph) if centrality is None else centrality
    free = graph.nodes.where(~F.coalesce("protected", F.lit(False))).select("node_id", "ord").join(centrality, "node_id")
    return remove_nodes(graph, held(free.orderBy("betweenness", "ord").limit(over).select("node_id")))
