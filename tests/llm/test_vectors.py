import numpy as np
from graphloom.llm import vectors as module
from graphloom.llm.vectors import fit_tree, search


def brute(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=float)
    out = {}
    for i, x in zip(ids, v, strict=True):
        if i % every == 0:
            score = (v * x).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAF_ROWS", 40)
    monkeypatch.setattr(module, "BLOCK_ROWS", 64)
    monkeypatch.setattr(module, "BLOCK_QUERIES", 16)
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(1500, 16)).astype(np.float32)
    v[200:700] = v[3]  # one vector holds a third of all rows
    rows = [(i, v[i].tolist()) for i in range(1500)]
    bad = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0] * 3, 1), (2080, [None] + [1.0] * 15, 1), (2100, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (0, rows[0][1], 1), (2120, [], 1)]
    d = spark.createDataFrame([(i, x, 1) for i, x in rows] + bad, "vec_id long, embedding array<float>, rank int")
    found = {}
    for r in search(d).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    wanted = brute(rows)
    assert sorted(found) == sorted(wanted)
    recall = []
    for q, best in wanted.items():
        assert sorted(found[q]) == list(range(1, 21))
        own = [found[q][r] for r in range(1, 21)]
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        scores = dict(best)
        assert all(abs(s - scores[i]) < 1e-12 for i, s in own if i in scores)
        recall.append(len(set(scores) & {i for i, _ in own}) / 20)
    assert np.mean(recall) >= 0.9
    same = [q for q in wanted if 200 <= q < 700]
    assert all([i for i, _ in wanted[q]] == [found[q][r][0] for r in range(1, 21)] for q in same)


def test_fewer_candidates_than_neighbours(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in search(d).orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert search(d.limit(0)).count() == 0 and search(d.where("vec_id = 1")).count() == 0


def test_leaves_are_visited_once_each():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    tree = fit_tree(x, 200_000)
    order = tree.visits(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 50
    assert tree.visits(x[0], 5) == order[:5]
    assert set(tree.assign(x)) <= set(range(tree.leaves))


def test_many_ties(spark, monkeypatch):
    """60 different vectors of one score: the smaller ids win, in blocks of whatever size."""
    monkeypatch.setattr(module, "LEAF_ROWS", 30)
    monkeypatch.setattr(module, "BLOCK_ROWS", 37)
    rnd = np.random.default_rng(7)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(1 + i, [0.5, *rnd.normal(size=3).tolist()]) for i in rnd.permutation(60).tolist()] + [(100 + i, [0.25, *rnd.normal(size=3).tolist()]) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in search(d, recall=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found[0] == [(i, 0.5) for i in range(1, 21)]
    assert found == {q: best for q, best in brute(rows).items()}
