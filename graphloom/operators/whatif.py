"""What-if overlays: a speculation changes edge weights as rows of its own, so that rolling it back is dropping rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions.vectors import cosine, literal, midpoint
from graphloom.operators.graph import Graph, neighbours
from graphloom.operators.similarity import similar_nodes

PREFIX = "__spec__"


@dataclass(frozen=True)
class Overlay:
    """The graph with the speculations' nodes and edges, their states, and the changes (schemas.DELTAS) of the active ones."""

    graph: Graph
    speculations: DataFrame
    deltas: DataFrame


def no_speculations(graph: Graph) -> Overlay:
    from graphloom.schemas import DELTAS, SPECULATIONS

    spark = graph.nodes.sparkSession
    return Overlay(graph, spark.createDataFrame([], SPECULATIONS), spark.createDataFrame([], DELTAS))


def node_rings(edges: DataFrame, start: str, radius: int) -> DataFrame:
    """(node_id, ring): breadth-first distance from `start` up to `radius`, both directions; the start itself is left out."""
    both = neighbours(edges).distinct()
    seen = both.where(F.col("id") == start).select(F.col("other").alias("node_id"), F.lit(1).alias("ring")).where(F.col("node_id") != start)
    for ring in range(2, radius + 1):
        further = seen.join(both.select(F.col("id").alias("node_id"), "other"), "node_id").select(F.col("other").alias("node_id"), F.lit(ring).alias("ring")).where(F.col("node_id") != start)
        seen = seen.unionByName(further).groupBy("node_id").agg(F.min("ring").alias("ring"))
    return seen


def propagate(graph: Graph, spec_id: str, vector, config: Config = Config()) -> DataFrame:
    """The changes (spec_id, src, dst, delta) of the edges within the radius: alpha * alignment * decay, each edge once, at its nearer end's distance.

    alignment: cosine of the speculation with the mean of the ends' vectors; 0 if an end has none.
    """
    rings = node_rings(graph.edges, spec_id, config.sem_radius)
    a, b = (rings.select(F.col("node_id").alias(end), F.col("ring").alias(f"_{end}")) for end in ("src", "dst"))
    near = graph.edges.select("src", "dst").join(a, "src", "left").join(b, "dst", "left").withColumn("ring", F.least("_src", "_dst")).where("ring IS NOT NULL")
    va, vb = (graph.nodes.select(F.col("node_id").alias(end), F.col("embedding").alias(f"v_{end}")) for end in ("src", "dst"))
    aligned = near.join(va, "src").join(vb, "dst").withColumn("alignment", F.coalesce(cosine(midpoint(F.col("v_src"), F.col("v_dst")), vector), F.lit(0.0)))
    delta = F.lit(config.sem_alpha) * F.col("alignment") * F.exp(F.lit(-config.sem_decay_rate) * F.col("ring"))
    return aligned.select(F.lit(spec_id).alias("spec_id"), "src", "dst", delta.alias("delta"))


def speculate(state: Overlay, spec_id: str, statement: str, vector: Sequence[float], config: Config = Config()) -> Overlay:
    """A speculation joins the graph: a node of its own, edges to the nodes most like it, and changes around them."""
    graph, spark = state.graph, state.graph.nodes.sparkSession
    v = literal(vector)
    spec = spark.createDataFrame([(spec_id, statement, [float(x) for x in vector], config.spec_initial_activation, "active")], state.speculations.schema)
    label = PREFIX + spec_id.removeprefix(PREFIX)[:8]
    node = spec.select(F.col("spec_id").alias("node_id"), F.lit(label).alias("label"), "embedding", "activation", F.lit(False).alias("protected"), F.lit("concept").alias("node_type"), F.lit(1.0).alias("agreement"), F.lit(1.0).alias("recency"), F.lit(1 << 60).cast("long").alias("ord"))
    near = similar_nodes(graph.nodes, vector, config.sem_anchor_threshold, config.sem_anchors)
    joined = near.select(F.lit(spec_id).alias("src"), F.col("node_id").alias("dst"), F.lit("speculative").alias("edge_type"), (F.col("similarity") * config.sem_alpha).alias("base_weight"), F.lit(1.0).alias("agreement"), (F.lit(1 << 60) + F.col("ord")).cast("long").alias("ord"))
    wider = Graph(graph.nodes.unionByName(node), graph.edges.unionByName(joined))
    return Overlay(wider, state.speculations.unionByName(spec), state.deltas.unionByName(propagate(wider, spec_id, v, config)))


def confirm(state: Overlay, spec_id: str, config: Config = Config()) -> Overlay:
    """The changes become base weights, max(0, base * (1 + delta)); the speculation's node stays, more active. Other speculations' changes then act on the new base."""
    own = state.deltas.where(F.col("spec_id") == spec_id).select("src", "dst", F.col("delta").alias("_d"))
    edges = state.graph.edges.join(own, ["src", "dst"], "left").withColumn("base_weight", F.when(F.col("_d").isNull(), F.col("base_weight")).otherwise(F.greatest(F.lit(0.0), F.col("base_weight") * (1.0 + F.col("_d")))))
    raised = F.when(F.col("node_id") == spec_id, F.lit(config.spec_confirmed_activation)).otherwise(F.col("activation"))
    return Overlay(Graph(state.graph.nodes.withColumn("activation", raised), edges.select(*state.graph.edges.columns)), _resolved(state, spec_id, "confirmed", config.spec_confirmed_activation), clear(state.deltas, spec_id))


def rollback(state: Overlay, spec_id: str) -> Overlay:
    """As if the speculation had never been: its changes, its node and its edges go."""
    graph = Graph(state.graph.nodes.where(F.col("node_id") != spec_id), state.graph.edges.where((F.col("src") != spec_id) & (F.col("dst") != spec_id)))
    return Overlay(graph, _resolved(state, spec_id, "disconfirmed", None), clear(state.deltas, spec_id))


def clear(deltas: DataFrame, spec_id: str | None = None) -> DataFrame:
    """Without the changes of one speculation, or of all."""
    return deltas.where(F.col("spec_id") != spec_id) if spec_id is not None else deltas.limit(0)


def _resolved(state: Overlay, spec_id: str, status: str, activation: float | None) -> DataFrame:
    this = F.col("spec_id") == spec_id
    level = F.col("activation") if activation is None else F.when(this, F.lit(activation)).otherwise(F.col("activation"))
    return state.speculations.withColumn("status", F.when(this, F.lit(status)).otherwise(F.col("status"))).withColumn("activation", level)


def active_speculations(state: Overlay) -> DataFrame:
    return state.speculations.where("status = 'active'")


def rollback_deviation(before: Overlay, after: Overlay) -> DataFrame:
    """One row: the greatest change of a base weight between the two, 0 for graphs without edges; edges in one alone count in full."""
    a, b = (s.graph.edges.select("src", "dst", F.col("base_weight").alias(n)) for s, n in ((before, "x"), (after, "y")))
    return a.join(b, ["src", "dst"], "full").agg(F.coalesce(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias("max_deviation"))
