"""A session: one working graph with its speculations, over a pattern library that outlives it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions.embedding import Embedder, HashEmbedder, embed, embed_labels
from graphloom.operators import ensemble, graph as g, lifecycle, whatif
from graphloom.operators.similarity import anchors
from graphloom.operators.traversal import local_graph, protected_by, query_paths
from graphloom.plans.ingest import document_rows, report_totals, simple_rows, simple_sentences
from graphloom.plans.narration import path_records
from graphloom.schemas import EDGES, NODES
from graphloom.sources.documents import read_documents, read_folder


class Session:
    """Each step replaces the tables it holds; old handles stay valid. `folder` is where they are written to cut their lineage."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, config: Config = Config(), library: lifecycle.Library | None = None, entity_id: str = "default"):
        self.spark, self.folder, self.config, self.entity_id = spark, folder, config, entity_id
        self._touched: set[str] = set()
        self.embedder = embedder or HashEmbedder()
        self.library = library or lifecycle.empty_library(spark)
        self.reset()

    def reset(self) -> None:
        empty = g.Graph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))
        self._touched = set()
        self.state = whatif.no_speculations(empty)
        self.other: g.Graph | None = None
        self.ensemble_mode, self.stability_score, self.documents, self.ingested = False, None, 0, False

    @property
    def state(self) -> whatif.Overlay:
        """The graph and its changes. What questions have touched since it was last looked at becomes protected first."""
        if self._touched:
            ids, self._touched = self.spark.createDataFrame([(i,) for i in sorted(self._touched)], "node_id string"), set()
            self._protect(ids)
        return self._state

    @state.setter
    def state(self, state: whatif.Overlay) -> None:
        self._state, self._local, self._measured = state, None, False

    @property
    def graph(self) -> g.Graph:
        return self.state.graph

    def _protect(self, ids: DataFrame) -> None:
        graph = self._state.graph
        nodes = graph.nodes.join(F.broadcast(ids.select(F.col("node_id").alias("_id"))) if self._measured and self._local else ids.select(F.col("node_id").alias("_id")), F.col("node_id") == F.col("_id"), "left")
        nodes = nodes.withColumn("protected", F.coalesce("protected", F.lit(False)) | F.col("_id").isNotNull()).select(*graph.nodes.columns)
        # protection changes no path, so what is held in memory stays
        self._state = whatif.Overlay(g.Graph(self._held(nodes), graph.edges), self._state.speculations, self._state.deltas)

    def _held(self, frame: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _hold(self, state: whatif.Overlay) -> None:
        self.state = whatif.Overlay(g.Graph(self._held(state.graph.nodes), self._held(state.graph.edges)), self._held(state.speculations), self._held(state.deltas))

    def ingest_graph(self, nodes: DataFrame, edges: DataFrame, reshape_all: bool = False) -> dict:
        """Merges nodes and edges into the graph, shapes the new nodes (all, if asked) by the library, and prunes."""
        c = self.config
        start = (self.graph.nodes.agg(F.max("ord")).first()[0] or 0) + 1
        last = (self.graph.edges.agg(F.max("ord")).first()[0] or 0) + 1
        names, links = [f.name for f in self.graph.nodes.schema], [f.name for f in self.graph.edges.schema]
        new = embed_labels(nodes.select(*names), self.embedder).withColumn("ord", F.col("ord") + start)
        both = self.graph.nodes.unionByName(new)
        graph = g.build_graph(both, self.graph.edges.unionByName(edges.select(*links).withColumn("ord", F.col("ord") + last)))
        graph = g.Graph(self._held(graph.nodes), self._held(graph.edges))
        fresh = graph.nodes if reshape_all else graph.nodes.join(self.graph.nodes.select("node_id"), "node_id", "left_anti").select(*names)
        found = self._held(lifecycle.match(fresh, self.library.structural, c.structural_match_threshold))
        shaped = g.Graph(self._held(lifecycle.boost(graph.nodes, found, c)), graph.edges)
        structural = lifecycle.refine_all(self.library.structural, fresh.join(found.select("node_id").distinct(), "node_id", "left_semi"), c)
        observed = lifecycle.observe(self.library.observations, lifecycle.unmatched(fresh, found), self.entity_id, c)
        self.library = lifecycle.Library(self._held(structural), self._held(observed), self.library.distributions)
        pruned = g.prune(shaped, c.max_nodes)
        self._hold(whatif.Overlay(pruned, self.state.speculations, self.state.deltas))
        self.ingested = True
        return {"nodes": self.graph.nodes.count(), "edges": self.graph.edges.count(), "structural_firings": found.select("node_id").distinct().count(), "observation_nodes": self.library.observations.count()}

    def ingest_text(self, text: str) -> dict:
        docs = self.spark.createDataFrame([("text", text)], "doc_id string, text string")
        sentences = self._held(simple_sentences(docs))
        if sentences.isEmpty():
            return {"error": "no sentences"}
        vectors = self._held(sentences.select("doc_id", "i", embed(F.col("sentence"), self.embedder).alias("v")))
        nodes, edges = simple_rows(sentences, vectors, self.config.semantic_edge_threshold)
        tag = uuid.uuid4().hex[:8]
        named = lambda c: F.concat(F.lit(tag + ":"), c).alias(c)
        nodes = nodes.drop("embedding").join(vectors.select(F.concat_ws(":", "doc_id", "i").alias("node_id"), F.col("v").alias("embedding")), "node_id").withColumn("node_id", named("node_id"))
        return self.ingest_graph(nodes, edges.withColumn("src", named("src")).withColumn("dst", named("dst")))

    def ingest_documents(self, documents: DataFrame) -> dict:
        """Documents (schemas.DOCUMENTS) in one batch; the report's totals, and the graph's size after it."""
        nodes, edges, report = document_rows(documents, self.embedder, self.config)
        report = self._held(report)
        totals = report_totals(report).first().asDict()
        self.documents += totals["files_ok"]
        self.report = report
        return totals | (self.ingest_graph(self._held(nodes), self._held(edges)) if totals["files_ok"] else {})

    def ingest_files(self, paths: list[str]) -> dict:
        return self.ingest_documents(self._held(read_documents(self.spark, [str(Path(p).expanduser()) if "://" not in p else p for p in paths])))

    def ingest_folder(self, folder: str, recursive: bool = True) -> dict:
        return self.ingest_documents(self._held(read_folder(self.spark, folder, recursive)))

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder.encode([text])[0]]

    def _queries(self, texts: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(i, self._vector(t)) for i, t in enumerate(texts)], "query_id int, vector array<double>")

    def paths(self, texts: Sequence[str]) -> DataFrame:
        """Paths for many questions at once; from both builds' agreement in ensemble mode."""
        queries = self._queries(texts)
        found = query_paths(self.graph, queries, self.config, self.state.deltas)
        return ensemble.agreed_paths(found, query_paths(self.other, queries, self.config)) if self.ensemble_mode and self.other else found

    def query(self, text: str) -> list[dict]:
        """The best paths for a question, best first. What it touches (its anchors and their neighbours) is protected from pruning.

        A graph that was measured to be small is held in memory from the first question on, until it changes: then a question takes no job.
        """
        if not self._measured:
            self._local, self._measured = local_graph(self.graph, self.state.deltas), True
        if self._local is not None and not (self.ensemble_mode and self.other):
            vector = self._vector(text)
            picked = self._local.anchors(vector, self.config.top_k_anchors)
            self._touched.update(picked, *(self._local.near.get(i, ()) for i in picked))
            found = enumerate(self._local.paths(vector, self.config), 1)
            return [{"query_id": 0, "rank": rank, "path": [self._local.labels.get(i) for i in path], "conductivity": round(value, 6), "hop_scores": [round(h, 4) for h in hops], "length": len(path)} for rank, (path, hops, value) in found]
        out = [r.asDict() for r in path_records(self._held(self.paths([text]))).orderBy("rank").collect()]
        self._protect(self._held(protected_by(self.graph, anchors(self.graph.nodes, self._queries([text]), self.config.top_k_anchors))))
        return out

    def speculate(self, statement: str) -> str:
        spec_id = whatif.PREFIX + uuid.uuid4().hex
        self._hold(whatif.speculate(self.state, spec_id, statement, self._vector(statement), self.config))
        return spec_id

    def confirm(self, spec_id: str) -> None:
        self._hold(whatif.confirm(self.state, spec_id, self.config))

    def rollback(self, spec_id: str) -> bool:
        """Takes a speculation back; whether no change of its own is left on any edge."""
        self._hold(whatif.rollback(self.state, spec_id))
        return self.state.deltas.where(F.col("spec_id") == spec_id).isEmpty() and self.graph.nodes.where(F.col("node_id") == spec_id).isEmpty()

    def measure_stability(self, other: g.Graph) -> float:
        """How far another build finds the same paths for the first nodes' vectors; the two answer together from then on if it is too little."""
        n = self.config.stability_sample_queries
        sample = self.graph.nodes.where(F.col("embedding").isNotNull()).orderBy("ord").limit(n).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("vector"))
        sample = self._held(sample)
        self.stability_score = ensemble.stability(query_paths(self.graph, sample, self.config), query_paths(other, sample, self.config)).first()["stability"]
        self.other, self.ensemble_mode = other, self.stability_score < self.config.stability_threshold
        return self.stability_score

    def end(self) -> dict:
        """The library takes in what the session's graph was like; the graph goes."""
        out = {}
        if self.ingested:
            degrees = self._held(g.degree_distribution(self.graph))
            library, counts = lifecycle.post_session(self.library, degrees, self.config)
            out = counts.first().asDict()
            self.library = lifecycle.Library(*(self._held(f) for f in (library.structural, library.observations, library.distributions)))
        self.reset()
        return out

    def stats(self) -> dict:
        out = g.summary(self.graph, self.state.deltas).first().asDict()
        return out | {"documents": self.documents, "stability": self.stability_score, "ensemble": self.ensemble_mode, "structural_patterns": self.library.structural.count(), "observations": self.library.observations.count(), "active_speculations": whatif.active_speculations(self.state).count()}
