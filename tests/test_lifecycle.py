import numpy as np
import pytest
from graphloom.config import Config
from graphloom.operators import lifecycle as lc
from graphloom.operators.similarity import linking_forest
from graphloom.schemas import OBSERVATIONS, STRUCTURAL
from graphloom.sources.library import library_info, load_library, save_library


def observation(i="o", vector=(1.0, 0.0), confirmations=4, entities=None, sessions=0):
    return (i, list(vector), confirmations, 0.0, 0.0, sessions, ["x"], entities or {"A": 2, "B": 1, "C": 1})


def library(spark, observations, distributions=(), structural=()):
    return lc.Library(spark.createDataFrame(list(structural), STRUCTURAL), spark.createDataFrame(list(observations), OBSERVATIONS), spark.createDataFrame(list(distributions), lc.DISTRIBUTIONS))


def wasserstein(a, b):
    at = sorted({*a, *b})
    return sum(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) * (y - x) for x, y in zip(at, at[1:], strict=False))


D = [[1.0, 2.0, 3.0, 10.0], [1.0, 1.0, 5.0, 5.0, 8.0], [2.0, 2.0, 2.0, 9.0]]
CONFIG = Config(min_confirmations=3, stabilisation_threshold=0.3)


def test_wasserstein(spark):
    rows = [("o", i, d) for i, d in enumerate(D)] + [("p", 1, [4.0]), ("p", 2, [4.0]), ("q", 1, [1.0])]
    found = {(r.obs_id, r.a, r.b): r.distance for r in lc.wasserstein_pairs(spark.createDataFrame(rows, lc.DISTRIBUTIONS)).collect()}
    assert found.keys() == {("o", 0, 1), ("o", 0, 2), ("o", 1, 2), ("p", 1, 2)} and found["p", 1, 2] == 0
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert found["o", i, j] == pytest.approx(wasserstein(D[i], D[j]))


def test_promotion(spark):
    degrees = spark.createDataFrame([(D[2],)], "degrees array<double>")
    before = library(spark, [observation("o"), observation("few", confirmations=2), observation("one", confirmations=6, entities={"A": 6}), observation("old", confirmations=1, sessions=19)], [(o, i + 1, D[i]) for o in ("o", "few", "one", "old") for i in range(2)])
    after, counts = lc.post_session(before, degrees, CONFIG)
    assert [r.node_id for r in after.structural.collect()] == ["o"]
    assert {r.node_id: r.sessions_active for r in after.observations.collect()} == {"few": 1, "one": 1}
    assert counts.first().asDict() == {"observation_nodes_evaluated": 4, "nodes_promoted": 1, "nodes_still_in_observation": 2, "stale_nodes_pruned": 1}
    score = 0.4 * np.mean([wasserstein(D[i], D[j]) for i, j in ((0, 1), (0, 2), (1, 2))])
    judged = lc.evaluate(before.observations, spark.createDataFrame([("o", i, d) for i, d in enumerate(D)], lc.DISTRIBUTIONS), CONFIG).where("node_id = 'o'").first()
    assert judged.stabilisation_score == pytest.approx(min(1, score)) and judged.ready


def test_observe_is_a_fold_in_order(spark):
    nodes = spark.createDataFrame([(f"label_{i}", [1.0, 0.01 * i], i) for i in range(10)] + [("far", [0.0, 1.0], 10), ("none", None, 11), ("zero", [0.0, 0.0], 12)], "label string, embedding array<double>, ord int")
    out = {tuple(r.example_labels): r for r in lc.observe(library(spark, []).observations, nodes, "e").collect()}
    assert len(out) == 2
    ring = out[tuple(f"label_{i}" for i in range(5, 10))]
    assert ring.confirmation_count == 10 and ring.entity_firing_counts == {"e": 10} and ring.pattern_embedding[1] == pytest.approx(0.045)
    again = lc.observe(lc.observe(library(spark, []).observations, nodes, "e"), nodes.where("ord = 0"), "f").where("confirmation_count = 11").first()
    assert again.entity_firing_counts == {"e": 10, "f": 1}
    near = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.8, 0.6], 2), ("c", [0.94, 0.34], 3)], "label string, embedding array<double>, ord int")
    first = {r.confirmation_count: r.example_labels for r in lc.observe(library(spark, []).observations, near, config=Config(observation_merge_threshold=0.93)).collect()}
    best = {r.confirmation_count: r.example_labels for r in lc.observe(library(spark, []).observations, near, config=Config(observation_merge_threshold=0.93), mode="best").collect()}
    assert first[2] == ["a", "c"] and best[2] == ["b", "c"]


@pytest.mark.parametrize("threshold,mode", [(0.9, "first"), (0.6, "first"), (0.7, "best")])
def test_groups_are_folded_as_one_row_after_the_other(spark, threshold, mode):
    """Clusters of vectors of any length, and older observations: as a plain fold over all of them."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 5))
    vectors = [(centres[i % 12] + rnd.normal(scale=0.5, size=5)) * rnd.uniform(0.2, 3) for i in range(150)]
    olds = [observation(f"o{i}", (centres[i] * 0.7).tolist(), confirmations=i) for i in range(4)]
    there = [[f"o{i}", np.array(o[1]), o[2]] for i, o in enumerate(olds)]
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for x in vectors:
        near = [(cosine(x, o[1]), -i) for i, o in enumerate(there) if cosine(x, o[1]) >= threshold]
        if near:
            o = there[-(max(near)[1] if mode == "best" else near[0][1])]
        else:
            o = ["new", np.zeros(5), 0]
            there.append(o)
        o[1], o[2] = (o[1] * o[2] + x) / (o[2] + 1), o[2] + 1
    nodes = spark.createDataFrame([(f"l{i}", x.tolist(), i) for i, x in enumerate(vectors)], "label string, embedding array<double>, ord int")
    out = lc.observe(library(spark, olds).observations, nodes.repartition(3), config=Config(observation_merge_threshold=threshold), mode=mode).collect()
    assert sorted((r.confirmation_count, round(r.pattern_embedding[0], 9)) for r in out) == sorted((n, round(v[0], 9)) for _, v, n in there)


def test_match_boost_and_refine(spark):
    s = [("p", [1.0, 0.0], 1, 0.5, True, "active", 0), ("q", [0.0, 1.0], 1, 0.5, True, "infrastructure", 0)]
    lib = library(spark, [], structural=s)
    nodes = spark.createDataFrame([("a", [1.0, 0.1], 0.8, 1), ("b", [0.6, 0.8], 0.9, 2), ("c", [-1.0, 0.0], 0.5, 3)], "node_id string, embedding array<double>, activation double, ord int")
    found = lc.match(nodes, lib.structural)
    assert {(r.node_id, r.pattern_id) for r in found.collect()} == {("a", "p"), ("b", "q")}
    boosted = {r.node_id: r.activation for r in lc.boost(nodes, found).collect()}
    assert boosted["a"] == pytest.approx(0.8 + 0.15 * 1 / np.hypot(1, 0.1)) and boosted["b"] == 1.0 and boosted["c"] == 0.5
    assert [r.node_id for r in lc.unmatched(nodes, found).collect()] == ["c"]
    moved = {r.node_id: r for r in lc.refine_all(lib.structural, nodes).collect()}
    wanted = np.array([0.95 + 0.05 * 0.6, 0.05 * 0.8])
    assert np.allclose(moved["p"].pattern_embedding, wanted / np.linalg.norm(wanted)) and moved["p"].reactivation_count == 1 and moved["p"].attention_mode == "infrastructure"
    assert moved["q"].pattern_embedding == [0.0, 1.0] and moved["q"].reactivation_count == 0
    assert lc.infrastructure_cost(lib.structural).first().asDict() == {"total": 2, "infrastructure": 1, "active": 1, "fraction": 0.5, "generalised": 2}


def test_file_round_trip(spark, tmp_path):
    s = [(f"node-{i:04d}", [0.1 * i, 1.0], i + 1, 0.3 + 0.1 * i, True, "active" if i == 1 else "infrastructure", i) for i in range(3)]
    lib = library(spark, [observation("o1"), observation("o2", entities={"é": 1})], [("o1", 1, [1.0, 2.0]), ("o1", 2, [3.0]), ("o2", 1, [])], s)
    path = str(tmp_path / "deep" / "library.json")
    for _ in range(2):
        assert save_library(lib, path)["nodes_saved"] == 3
        back = load_library(spark, path)
        for a, b in zip((lib.structural, lib.distributions), (back.structural, back.distributions), strict=True):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert sorted(str(r.asDict()) for r in lib.observations.collect()) == sorted(str(r.asDict()) for r in back.observations.collect())
        path = str(tmp_path / "second.json")
        lib = back
    info = library_info(spark, path)
    assert info["node_count"] == 3 and info["observation_count"] == 2 and info["size_bytes"] > 100
    assert library_info(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        load_library(spark, str(tmp_path / "none"))
    for text in ('{"x_version": "99.0", "nodes": []}', '{"format_version": "1.1"}', "[]"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            load_library(spark, str(tmp_path / "bad.json"))
    (tmp_path / "old.json").write_text('{"any_version": "1.0", "nodes": [{"node_id": "n", "pattern_embedding": [1.0]}]}')
    old = load_library(spark, str(tmp_path / "old.json"))
    assert old.structural.first().attention_mode == "infrastructure" and old.observations.count() == 0


def test_one_file_for_a_person_to_read(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    lib = lc.record_distribution(library(spark, [observation("o", entities={"A": 2, "B": 1})], [("o", 1, [1.0])], [("p", [1.0, 0.5], 1, 0.5, True, "active", 0)]), "o", [2, 3.0])
    assert save_library(lib, "~/deep/er/lib.json")["path"] == str(tmp_path / "deep/er/lib.json")
    text = (tmp_path / "deep/er/lib.json").read_text()
    assert text.startswith('{\n  "format_version"') and '\n      "pattern_embedding": [' in text and [x.name for x in (tmp_path / "deep/er").iterdir()] == ["lib.json"]
    back = load_library(spark, "~/deep/er/lib.json")
    assert [tuple(r) for r in lc.session_distributions(back, "o").collect()] == [(1, [1.0]), (2, [2.0, 3.0])]
    assert {tuple(r) for r in lc.entity_counts(back, "o").collect()} == {("A", 2), ("B", 1)}
    assert lc.library_summary(back).first().asDict() == {"total": 1, "infrastructure": 0, "active": 1, "fraction": 0.0, "generalised": 1, "candidates": 1}
    nodes = spark.createDataFrame([("a", [1.0, 0.5])], "node_id string, embedding array<double>")
    assert [r.node_id for r in lc.firing_patterns(back.structural, lc.match(nodes, back.structural)).collect()] == ["p"]
    monkeypatch.setattr("graphloom.sources.library.MOST_BYTES", 100)
    with pytest.raises(ValueError):
        save_library(lib, "~/deep/er/lib.json")
    assert (tmp_path / "deep/er/lib.json").read_text() == text
    (tmp_path / "text.json").write_text('{"format_version": "1.1", "note": "\\"nodes\\": []"}')
    with pytest.raises(ValueError):
        load_library(spark, str(tmp_path / "text.json"))


def test_observing_nodes_that_are_all_alike_keeps_few_links(spark):
    """A crowd of like vectors has links by the square of its size; what is written to find its group is no more than a few for each node and task."""
    rnd = np.random.default_rng(6)
    vectors = np.vstack([rnd.normal(size=(600, 6)) * 0.3 + np.eye(6)[0], rnd.normal(size=(30, 6)) * 0.01 - np.eye(6)[0], rnd.normal(size=(3, 6)) * 0.01 - np.eye(6)[1] * 5])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"n{i}", x.tolist()) for i, x in enumerate(vectors)], "a string, v array<double>").repartition(3)
    for block, cap in ((1024, 64_000_000), (50, 64_000_000), (50, 6 * 8 * 200)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr("graphloom.operators.similarity.BROADCAST_BYTES", cap)
            m.setattr("graphloom.operators.similarity.BLOCK", block)
            forest = linking_forest(rows, rows.withColumnRenamed("a", "b"), 0.49).collect()
        assert len(forest) < 10 * len(vectors)  # all links: over 100,000
        assert groups((r.a, r.b) for r in forest) == groups((f"n{i}", f"n{j}") for i, j in zip(*np.nonzero(unit @ unit.T >= 0.49), strict=True) if i != j)


def groups(links):
    at = {}
    for a, b in links:
        a, b = (at.setdefault(x, {x}) for x in (a, b))
        if a is not b:
            a |= b
            at |= dict.fromkeys(b, a)
    return sorted(sorted(x) for x in {id(x): x for x in at.values()}.values())
