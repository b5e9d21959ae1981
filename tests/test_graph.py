import random
import itertools
import math

import pytest
from graphloom.config import Config
from graphloom.operators import ensemble, whatif
from graphloom.operators import graph as g
from graphloom.operators.similarity import similar_nodes, similarity_join, window_edges
from graphloom.operators.traversal import beam_search, hop_scores, path_conductivity, query_paths
from graphloom.schemas import EDGES, NODES
from pyspark.sql import functions as F


def node(i, label, activation=0.7, protected=False, embedding=None, ord=None, recency=1.0, agreement=1.0):
    return (i, label, embedding, activation, protected, "concept", agreement, recency, ord if ord is not None else int("".join(c for c in i if c.isdigit()) or 0))


def edge(src, dst, kind="causal", weight=None, ord=0):
    return (src, dst, kind, weight, 1.0, ord)


def graph(spark, nodes, edges):
    return g.build_graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([e[:5] + (e[5] or i,) for i, e in enumerate(edges)], EDGES))


def simple(spark):
    return graph(spark, [node("1", "Solar energy", 0.8, embedding=[1.0, 0.0]), node("2", " photovoltaic cells", 0.7, embedding=[0.8, 0.6]), node("3", "electricity generation", 0.9, embedding=[0.0, 1.0])], [edge("1", "2", "causal", 0.85), edge("2", "3", "causal", 0.80)])


def test_hops_and_conductivity(spark):
    graph_ = simple(spark)
    scores = {(r.src, r.dst): r.score for r in hop_scores(graph_).collect()}
    assert scores[("1", "2")] == pytest.approx(0.595, abs=1e-10) and scores[("2", "3")] == pytest.approx(0.72, abs=1e-10)
    paths = spark.createDataFrame([(1, ["1", "2", "3"]), (2, ["1"]), (3, ["3", "1"]), (4, [])], "path_id int, node_ids array<string>")
    out = {r.path_id: r for r in path_conductivity(paths, hop_scores(graph_)).collect()}
    assert out[1].conductivity == pytest.approx(math.sqrt(0.595 * 0.72), abs=1e-10)
    assert out[2].conductivity == out[3].conductivity == out[4].conductivity == 0.0 and out[2].hop_scores == []


def test_zero_edge_and_length(spark):
    chain = [node(str(i), f"n{i}", 1.0) for i in range(4)]
    ones = graph(spark, chain, [edge(str(i), str(i + 1), "causal", 1.0) for i in range(3)])
    paths = spark.createDataFrame([(1, ["0", "1", "2"]), (2, ["0", "1", "2", "3"])], "path_id int, node_ids array<string>")
    assert {r.conductivity for r in path_conductivity(paths, hop_scores(ones)).collect()} == {1.0}
    zero = graph(spark, chain, [edge("0", "1", "causal", 0.8), edge("1", "2", "causal", 0.0)])
    assert path_conductivity(paths.where("path_id = 1"), hop_scores(zero)).first().conductivity == 0.0


def test_labels_merge_and_edges_follow(spark):
    nodes = [node("1", "Shared Concept", 0.5), node("2", "shared concept ", 0.8, True, [1.0]), node("3", "other")]
    out = graph(spark, nodes, [edge("1", "3", "causal"), edge("2", "3", "semantic"), edge("1", "2"), edge("3", "9"), edge("3", "2", "analogical", 0.6)])
    merged = {r.label: r for r in out.nodes.collect()}
    assert len(merged) == 2 and merged["shared concept"].activation == 0.8 and merged["shared concept"].node_id == "1"
    assert merged["shared concept"].protected and merged["shared concept"].embedding == [1.0]
    edges = {(r.src, r.dst): (r.edge_type, r.base_weight) for r in out.edges.collect()}
    assert edges == {("1", "3"): ("semantic", 0.55), ("3", "1"): ("analogical", 0.60)}


def test_effective_weight(spark):
    edges = spark.createDataFrame([("a", "b", "causal", 0.8, 1.0, 0), ("b", "c", "causal", 0.8, 1.0, 1)], EDGES)
    deltas = spark.createDataFrame([("s1", "a", "b", 0.25), ("s2", "a", "b", 0.10), ("s1", "b", "c", -3.0)], "spec_id string, src string, dst string, delta double")
    out = {r.src: r.effective_weight for r in g.with_effective_weight(edges, deltas).collect()}
    assert out["a"] == pytest.approx(1.08, abs=1e-10) and out["b"] == 0.0


def test_prune_keeps_protected(spark):
    chain = graph(spark, [node(str(i), f"concept {i}", protected=i == 0) for i in range(10)], [edge(str(i), str(i + 1), "sequential") for i in range(9)])
    out = g.prune(chain, 5)
    ids = {r.node_id for r in out.nodes.collect()}
    assert "0" in ids and len(ids) == 5 and "9" not in ids
    assert all(r.src in ids and r.dst in ids for r in out.edges.collect())
    assert g.prune(chain, 50) is chain


def brute_betweenness(n, edges):
    best = {}
    for s, t in itertools.permutations(range(n), 2):
        paths = []

        def walk(path, cost):
            if path[-1] == t:
                paths.append((round(cost, 9), path))
                return
            for a, b, w in edges:
                if a == path[-1] and b not in path:
                    walk([*path, b], cost + w)

        walk([s], 0.0)
        best[s, t] = [p for c, p in paths if c == min(paths)[0]] if paths else []
    return [sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in best.values() if ps) / ((n - 1) * (n - 2)) for v in range(n)]


def test_betweenness(spark):
    edges = [(0, 1, 0.5), (1, 2, 0.5), (0, 2, 1.0), (2, 3, 0.3), (3, 4, 0.2), (1, 4, 1.0), (4, 0, 0.7), (2, 4, 0.5)]
    out = graph(spark, [node(str(i), f"n{i}") for i in range(6)], [edge(str(a), str(b), "causal", w) for a, b, w in edges])
    found = {r.node_id: r.betweenness for r in g.betweenness(out).collect()}
    for i, wanted in enumerate(brute_betweenness(6, edges)):
        assert found[str(i)] == pytest.approx(wanted, abs=1e-9)
    assert g.betweenness(graph(spark, [node("1", "a")], [])).first().betweenness == 0.0


def test_betweenness_of_larger_graphs_by_joins(spark, monkeypatch):
    rnd = random.Random(3)
    pairs = rnd.sample([(a, b) for a in range(30) for b in range(30) if a != b], 110)
    out = graph(spark, [node(str(i), f"n{i}") for i in range(31)], [edge(str(a), str(b), "causal", rnd.choice([0.25, 0.5, 0.75, 1.0])) for a, b in pairs])
    local = {r.node_id: r.betweenness for r in g.betweenness(out).collect()}
    monkeypatch.setattr(g, "LOCAL_EDGES", 5)
    joined = {r.node_id: r.betweenness for r in g.betweenness(out).collect()}
    assert joined.keys() == local.keys() and all(joined[k] == pytest.approx(local[k], abs=1e-12) for k in local) and max(local.values()) > 0
    monkeypatch.setattr(g, "PIVOTS", 20)
    some = {r.node_id: r.betweenness for r in g.betweenness(out).collect()}
    assert 0.5 < sum(some.values()) / sum(local.values()) < 2


def test_degrees_protection_and_removal(spark):
    out = simple(spark)
    assert g.degree_distribution(out).first().degrees == [1.0, 1.0, 2.0]
    assert g.degree_distribution(g.Graph(out.nodes.limit(0), out.edges.limit(0))).first().degrees == [0.0]
    anchors = out.nodes.where("node_id = '1'")
    assert {r.node_id for r in g.protect_around(out, anchors).nodes.where("protected").collect()} == {"1", "2"}
    assert g.remove_nodes(out, out.nodes.where("node_id = '2'")).edges.count() == 0
    assert g.get_node_by_label(out, " SOLAR energy").count() == g.get_edge(out, "1", "2").count() == 1
    assert g.edges_to(out, anchors).count() == 0 and g.edges_from(out, anchors).count() == 1
    assert g.summary(out).first().asDict() == {"nodes": 3, "edges": 2, "protected": 0, "sem_active": 0}


def plain_beam(scores, order, start, width, depth, k, visited=()):
    """Beam search over dictionaries, as the words say it."""
    beam, ended = [([start], 0.0, [])], []
    for _ in range(depth):
        made = []
        for path, logs, hops in beam:
            more = [(path + [b], logs + math.log(scores[a, b]), hops + [scores[a, b]]) for a, b in order if a == path[-1] and b not in path and b not in visited and scores[a, b] > 0]
            if not more and hops:
                ended.append((path, logs, hops))
            made += more
        if not made:
            beam = []
            break
        beam = sorted(made, key=lambda x: -x[1] / len(x[2]))[:width]
    ended += [b for b in beam if b[2]]
    return [tuple(p) for p, *_ in sorted(ended, key=lambda x: -math.exp(x[1] / len(x[2])))[:k]]


@pytest.mark.parametrize("seed,width", [(1, 3), (2, 10), (3, 2)])
def test_beam_is_that_of_plain_code(spark, seed, width):
    import random

    rnd = random.Random(seed)
    pairs = rnd.sample([(a, b) for a in range(12) for b in range(12) if a != b], 40)
    nodes = [node(str(i), f"n{i}", rnd.choice([0.5, 0.7, 0.9])) for i in range(12)]
    out = graph(spark, nodes, [edge(str(a), str(b), rnd.choice(["causal", "semantic"]), None, i + 1) for i, (a, b) in enumerate(pairs)])
    rows = hop_scores(out).orderBy("ord").collect()
    scores = {(r.src, r.dst): r.score for r in rows}
    starts = spark.createDataFrame([(s, str(s)) for s in (0, 5, 11)], "query_id int, node_id string")
    closed = spark.createDataFrame([(5, ["1", "2"])], "query_id int, nodes array<string>")
    found = beam_search(starts, hop_scores(out), Config(beam_width=width), closed).orderBy("query_id", "place").collect()
    for s in (0, 5, 11):
        wanted = plain_beam(scores, [(r.src, r.dst) for r in rows], str(s), width, 5, 5, ("1", "2") if s == 5 else ())
        assert [tuple(r.node_ids) for r in found if r.query_id == s] == wanted
    for r in found:
        assert len(set(r.node_ids)) == len(r.node_ids) and 0 < r.conductivity <= 1


def test_queries(spark):
    out = simple(spark)
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "query_id int, vector array<double>")
    found = query_paths(out, queries).orderBy("rank").collect()
    assert found[0].labels[0] in ("solar energy", "photovoltaic cells") and {r.query_id for r in found} == {1}
    empty = g.Graph(out.nodes.limit(0), out.edges.limit(0))
    assert query_paths(empty, queries).count() == 0
    assert similar_nodes(out.nodes, [1.0, 0.0], 0.0, 2).collect()[0].node_id == "1"


def test_agreement_of_two_builds(spark):
    a = spark.createDataFrame([(1, 1, ["x", "y"]), (1, 2, ["x", "z"]), (2, 1, ["q"])], "query_id int, rank int, labels array<string>")
    b = spark.createDataFrame([(1, 1, ["x", "y"]), (1, 2, ["w"])], "query_id int, rank int, labels array<string>")
    assert ensemble.stability(a, b).first().stability == pytest.approx(1 / 4)
    assert ensemble.stability(a.limit(0), b.limit(0)).first().stability == 1.0
    assert sorted((r.query_id, r.labels) for r in ensemble.agreed_paths(a, b).collect()) == [(1, ["x", "y"]), (2, ["q"])]


def test_speculation_confirm_and_rollback(spark):
    before = whatif.no_speculations(simple(spark))
    state = whatif.speculate(before, "__spec__1", "light to power", [1.0, 0.2])
    spec = state.graph.nodes.where("node_id = '__spec__1'").first()
    assert spec.activation == 0.3 and spec.label.startswith("__spec__")
    assert state.deltas.count() > 0
    assert sorted(state.graph.edges.where("edge_type <> 'speculative'").collect()) == sorted(before.graph.edges.collect())
    d = {(r.src, r.dst): r.delta for r in state.deltas.collect()}
    mid = [0.9, 0.3]
    aligned = (mid[0] + 0.2 * mid[1]) / (math.hypot(*mid) * math.hypot(1, 0.2))
    assert d["1", "2"] == pytest.approx(0.4 * aligned * math.exp(-0.5))
    second = whatif.speculate(state, "__spec__2", "other", [0.0, 1.0])
    back = whatif.rollback(second, "__spec__1")
    assert back.deltas.where("spec_id = '__spec__1'").count() == 0 and back.deltas.where("spec_id = '__spec__2'").count() > 0
    gone = whatif.rollback(whatif.rollback(second, "__spec__2"), "__spec__1")
    assert gone.graph.edges.exceptAll(before.graph.edges).count() == before.graph.edges.exceptAll(gone.graph.edges).count() == 0
    assert gone.graph.nodes.exceptAll(before.graph.nodes).count() == 0 and whatif.rollback_deviation(before, gone).first()[0] < 1e-9
    sure = whatif.confirm(state, "__spec__1")
    weights = {(r.src, r.dst): r.base_weight for r in sure.graph.edges.collect()}
    assert weights["1", "2"] == pytest.approx(0.85 * (1 + d["1", "2"])) and sure.deltas.count() == 0
    assert sure.speculations.first().status == "confirmed" and whatif.active_speculations(second).count() == 2
    nothing = whatif.no_speculations(g.Graph(before.graph.nodes.limit(0), before.graph.edges.limit(0)))
    assert whatif.speculate(nothing, "__spec__3", "x", [1.0]).deltas.count() == 0


def test_similarity_join_in_blocks(spark, monkeypatch):
    import numpy as np
    from graphloom.operators import similarity as module

    rnd = np.random.default_rng(1)
    a = spark.createDataFrame([(f"a{i}", rnd.normal(size=4).tolist()) for i in range(60)] + [("z", [0.0] * 4), ("n", None)], "l string, v array<double>")
    b = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(50)], "r long, v array<double>")
    wide = sorted(map(tuple, similarity_join(a, b, 0.5, "l", "r").select("l", "r").collect()))
    monkeypatch.setattr(module, "BROADCAST_BYTES", 500)  # four slices
    monkeypatch.setattr(module, "BLOCK", 16)
    assert sorted(map(tuple, similarity_join(a, b, 0.5, "l", "r").select("l", "r").collect())) == wide and wide
    assert similarity_join(a, b.limit(0), 0.5, "l", "r").count() == 0
    other = b.unionByName(spark.createDataFrame([(99, [1.0, 2.0])], "r long, v array<double>"))  # of another length
    assert sorted(map(tuple, similarity_join(a, other, 0.5, "l", "r").select("l", "r").collect())) == wide


def test_window_edges_look_ahead(spark):
    v = spark.createDataFrame([(1, i, f"s{i}", [1.0, float(i % 2)]) for i in range(8)], "doc int, pos int, id string, v array<double>")
    found = {(r.src, r.dst) for r in window_edges(v, 0.99).collect()}
    assert found == {(f"s{i}", f"s{j}") for i in range(8) for j in range(8) if 2 <= j - i <= 5 and (j - i) % 2 == 0}
    assert v.where(F.lit(False)).count() == 0


def test_small_and_large_graphs_give_the_same_paths(spark, monkeypatch):
    import random

    from graphloom.operators import traversal

    rnd = random.Random(9)
    nodes = [node(str(i), f"n{i}", rnd.choice([0.5, 0.7, 0.9]), embedding=[rnd.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [node("40", "none"), node("41", "zero", embedding=[0.0] * 4)]
    pairs = rnd.sample([(a, b) for a in range(30) for b in range(30) if a != b], 120)
    out = graph(spark, nodes, [edge(str(a), str(b), rnd.choice(["causal", "semantic", "sequential"]), None, i + 1) for i, (a, b) in enumerate(pairs)])
    queries = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(12)] + [(99, None), (98, [0.0] * 4)], "query_id int, vector array<double>")
    rows = lambda: sorted((r.query_id, r.rank, r.labels, round(r.conductivity, 9), r.length, [round(h, 9) for h in r.hop_scores]) for r in query_paths(out, queries, Config(beam_width=3)).collect())
    small = rows()
    monkeypatch.setattr(traversal, "LOCAL_HOPS", 0)
    assert rows() == small and len(small) > 30


def test_facts_of_hot_keys(spark, monkeypatch):
    from graphloom.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = spark.range(300).selectExpr("CASE WHEN id < 100 THEN 1 WHEN id < 111 THEN 2 ELSE id END AS key", "id")
    facts = rows.where("key < 290").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    out = skew.join_facts(rows, facts, "key", "n", 300)
    assert out.columns == ["key", "id", "first", "last"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.join(facts, "key").select("key", "id", "first", "last").collect()))


def test_components_of_stars_and_chains(spark, tmp_path):
    from graphloom.operators.components import connected_components
    from graphloom.scratch import Scratch

    links = [(0, i) for i in range(2000, 6000)] + [(i, i + 1) for i in range(7000, 7300)] + [(9000 - i, 9001) for i in range(1, 50)] + [(5, 5)]
    out = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.component for r in out} == {0, 7000, 8951} and len(out) == 4001 + 301 + 50
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
