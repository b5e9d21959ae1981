import time

import numpy as np
from graphloom.cli import answer, run_demo, safe_save
from graphloom.config import Config
from graphloom.functions.embedding import HashEmbedder
from graphloom.operators.graph import Graph
from graphloom.operators import whatif
from graphloom.operators.similarity import anchors
from graphloom.operators.traversal import protected_by
from graphloom.plans.narration import load_narrator, one_prompt, path_lines, path_records, prompts
from graphloom.plans.session import Session
from graphloom.schemas import EDGES, NODES

LABELS = [("climate change", 0.8), ("carbon emissions", 0.7), ("global warming", 0.9), ("renewable energy", 0.75)]


def rows(spark):
    nodes = [(f"n{i}", label, None, a, False, "concept", 1.0, 1.0, i) for i, (label, a) in enumerate(LABELS)]
    edges = [("n0", "n1", "causal", None, 1.0, 0), ("n1", "n2", "causal", None, 1.0, 1), ("n2", "n3", "contrastive", None, 1.0, 2), ("n0", "n3", "analogical", None, 1.0, 3)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_a_session_from_start_to_end(spark, tmp_path):
    s = Session(spark, str(tmp_path), HashEmbedder(16), entity_id="e1")
    assert s.query("anything") == []
    out = s.ingest_graph(*rows(spark))
    assert out["nodes"] == 4 and out["edges"] == 4 and out["observation_nodes"] == 4
    paths = s.query("climate change")
    assert paths and paths[0]["path"][0] == "climate change" and all(0 < p["conductivity"] <= 1 for p in paths)
    assert s.stats()["protected"] >= 3
    base = sorted(map(str, s.graph.edges.select("src", "dst", "base_weight").collect()))
    spec = s.speculate("climate change")
    assert s.stats()["active_speculations"] == 1 and s.stats()["sem_active"] > 0
    s.query("climate change")
    assert s.rollback(spec) and sorted(map(str, s.graph.edges.select("src", "dst", "base_weight").collect())) == base
    other = s.speculate("global warming")
    s.confirm(other)
    assert s.stats()["active_speculations"] == 0 and sorted(map(str, s.graph.edges.select("src", "dst", "base_weight").collect())) != base
    again = s.ingest_graph(*rows(spark))
    assert again["nodes"] == 5 and s.library.observations.count() == 4
    assert s.measure_stability(Graph(s.graph.nodes, s.graph.edges)) == 1.0 and not s.ensemble_mode
    counts = s.end()
    assert counts["observation_nodes_evaluated"] == 4 and s.graph.nodes.count() == 0 and s.library.observations.first().sessions_active == 1
    assert s.end() == {}


def test_texts_files_and_console(spark, tmp_path):
    s = Session(spark, str(tmp_path / "t"), HashEmbedder(16), Config(max_nodes=6))
    text = "Coal power causes carbon output. Wind turbines make clean power. Batteries store the clean power. Grids move the stored power. Homes use what the grids bring. Markets set the price of power. Rules change what markets do."
    assert s.ingest_text("no.") == {"error": "no sentences"}
    assert s.ingest_text(text)["nodes"] == 6
    (tmp_path / "doc.md").write_text("# Power\n\n" + text)
    lib = str(tmp_path / "lib.json")
    assert "'files_ok': 1" in answer(s, f":ingest {tmp_path / 'doc.md'} {tmp_path / 'none.md'}")
    assert "paths" in answer(s, "what moves power?") and "nodes" in answer(s, ":stats") and "observations" in answer(s, ":library")
    spec = answer(s, ":speculate wind is cheap")
    assert answer(s, f":rollback {spec}") == "rolled back" and answer(s, f":confirm {answer(s, ':speculate x')}") == "confirmed"
    assert "nodes_saved" in answer(s, ":save", lib) and "no library" in answer(s, ":save")
    assert answer(s, ":quit") is None and answer(s, "") == "" and ":ingest" in answer(s, ":help") and "unknown" in answer(s, ":nope")


def test_a_warm_question_takes_no_job(spark, tmp_path):
    """2000 nodes held in memory: the paths are those of joins, what a question touches is protected when the graph is looked at next."""
    rnd = np.random.default_rng(4)
    s = Session(spark, str(tmp_path), HashEmbedder(16), Config(max_nodes=5000))
    vectors = rnd.normal(size=(2000, 16))
    nodes = spark.createDataFrame([(f"n{i}", f"label {i}", vectors[i].tolist(), 0.8, False, "concept", 1.0, 1.0, i) for i in range(2000)], NODES)
    pairs = sorted({(int(a), int(b)) for a, b in rnd.integers(0, 2000, (6000, 2)) if a != b})
    s.state = whatif.no_speculations(Graph(s._held(nodes), s._held(spark.createDataFrame([(f"n{a}", f"n{b}", "causal", None, 1.0, i) for i, (a, b) in enumerate(pairs)], EDGES).fillna({"base_weight": 0.85}))))
    s.query("first")
    began = time.perf_counter()
    warm = {q: s.query(q) for q in ("one", "two", "three", "four")}
    assert (time.perf_counter() - began) / 4 < 0.1
    found = path_records(s.paths([*warm])).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.path, r.conductivity) for r in found] == [(r["rank"], r["path"], r["conductivity"]) for q in warm.values() for r in q]
    touched = protected_by(s.graph, anchors(s.graph.nodes, s._queries(["first", *warm]), 3))
    assert {r.node_id for r in s.graph.nodes.where("protected").collect()} == {r.node_id for r in touched.collect()}
    questions = spark.createDataFrame([(0, "one")], "query_id int, query string")
    assert prompts(questions, path_lines(s.paths(["one"]))).first().prompt == one_prompt("one", warm["one"])


def test_demo(spark, tmp_path):
    out = run_demo(spark, str(tmp_path), "grid", narrator=lambda prompt, max_tokens, temperature: iter(["told: ", prompt[:13]]))
    assert "paths" in out and "told: <|im_start|>u" in out and "rolled back" in out and "observation_nodes_evaluated" in out
    assert load_narrator(None) is None and load_narrator("/no/such.gguf") is None
    s = Session(spark, str(tmp_path / "s"), HashEmbedder(8))
    assert "not saved" in safe_save(s, str(tmp_path)) and "nodes_saved" in safe_save(s, str(tmp_path / "new" / "lib.json"))
