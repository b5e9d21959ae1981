import numpy as np
from graphloom.llm.toxicity import SeverityModel, fit_cumulative_link, fit_severity, severity, toxicity


def test_four_grades_share_weights_and_keep_their_order():
    rnd = np.random.default_rng(1)
    true = np.array([2.0, 1.0, -1.5, 0.0, 0.5])
    rows = [np.flatnonzero(rnd.random(5) < 0.5) for _ in range(4000)]
    score = np.array([true[r].sum() for r in rows]) + rnd.logistic(size=4000)
    grades = np.digitize(score, [0.0, 1.0, 2.5])
    w, t = fit_cumulative_link(rows, grades, np.ones(4000), 5, steps=800)
    assert (np.diff(t) > 0).all() and np.abs(w - true).max() < 0.3 and np.abs(t - [0, 1, 2.5]).max() < 0.3
    model = SeverityModel({str(i): x for i, x in enumerate(w)}, list(t))
    assert all(np.diff(model.above(text)).max() <= 0 for text in (None, "", "a b"))


def data(spark):
    rnd, rows, labels = np.random.default_rng(3), [], []
    neutral, bad = [f"n{chr(97 + i)}x" for i in range(26)], ["awful", "horrid", "vile"]
    for i in range(600):
        words = list(rnd.choice(neutral, 30))
        if toxic := int(i % 7 == 0):
            words[3:3] = list(rnd.choice(bad, 2))
        rows.append((i, " ".join(words), 0))
        if i % 2 == 0:
            labels.append((i, toxic, 1))
    rows += [(1000, None, 0), (1001, "", 0), (None, "awful vile", 0), (1, rows[1][1], 0), (1002, "nax nbx " * 30000, 0)]
    labels += [(0, 0, 1), (None, 1, 1), (5000, 1, 1), (2, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, grade int"), spark.createDataFrame(labels, "doc_id long, grade int, text int")


def test_unseen_documents_and_edge_cases(spark):
    docs, labels = data(spark)
    out = toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.toxic == (r.doc_id % 7 == 0), r
            assert r.expected_severity > 0.5 if r.toxic else r.expected_severity < 0.5
    by_id = {r.doc_id: r for r in out}
    assert by_id[None].toxic and not any(by_id[i].toxic for i in (1000, 1001, 1002)) and by_id[1000].grade == 0
    assert len(fit_severity(docs, labels).thresholds) == 2


def test_nothing_to_learn_from(spark):
    docs, labels = data(spark)
    assert not any(r.toxic for r in toxicity(docs, labels.limit(0)).collect())
    assert not any(r.toxic for r in toxicity(docs, labels.where("grade = 1")).collect())
    assert toxicity(docs.limit(0), labels).count() == 0
    kept = severity(docs, SeverityModel({"awful": 9.0}, [4.0]))
    assert kept.columns == ["doc_id", "text", "grade", "severity"]
