import numpy as np
from graphloom.llm.language_id import codewords, held_out, language_id, ngram_features
from graphloom.llm.sampling import bounded_sample
from pyspark.sql import functions as F

WORDS = {"en": "the and of to that with house river".split(), "fr": "le la de que avec maison rivière une".split(), "de": "der die und mit haus fluß nicht eine".split()}


def docs(spark, n=240):
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rnd = np.random.default_rng(i)
        rows.append((i, " ".join(rnd.choice(WORDS[lang], 1 + i % 40)), lang, f"s{i % 2}", 7.5))
    rows += [(n, None, "en", None, 0.0), (n + 1, "123 ... !!", "fr", None, 0.0), (n + 2, "", "de", None, 0.0), (None, "the house and the river", None, None, 0.0), (0, rows[0][1], rows[0][2], "s0", 7.5), (n + 3, "the river " * 20000, None, None, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def test_codewords_differ():
    for n in (2, 3, 5, 9, 40):
        code = codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert apart[~np.eye(n, dtype=bool)].min() >= 1
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_features_do_not_depend_on_the_pieces(monkeypatch):
    import graphloom.llm.language_id as module

    text = "Ein längerer Text mit Wörtern " * 50
    whole = ngram_features(text)
    monkeypatch.setattr(module, "PIECE", 100)
    assert np.allclose(ngram_features(text), whole) and abs((whole**2).sum() - 1) < 1e-3


def test_held_out_accuracy_and_edge_cases(spark):
    d = docs(spark)
    out = language_id(d).join(d.select("doc_id", "lang").distinct(), "doc_id", "left").collect()
    assert len(out) == d.count()
    told = [r for r in out if r.lang and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in told if r.held_out]) > 0.9
    by_id = {r.doc_id: r for r in out}
    for i in (240, 241, 242):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].ambiguous
    assert by_id[243].lang_pred == "en" and by_id[None].lang_pred == "en" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in out)
    assert d.select(held_out().alias("h")).where("h").count() > 20


def test_nothing_to_learn_from(spark):
    d = docs(spark)
    assert language_id(d.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(d.withColumn("lang", d.lang.substr(9, 1).cast("string")).where("lang IS NULL")).collect()} <= {"und"}
    one = language_id(d.where("lang = 'en'"))
    assert {r.lang_pred for r in one.collect()} <= {"en", "und"}


def test_sample_of_a_share_below_a_millionth(spark):
    rows = spark.range(20_000_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, "few").otherwise("many").alias("lang"))
    sample, totals = bounded_sample(rows, "lang", "doc_id", 16)
    found = [r.lang for r in sample.collect()]
    assert totals == {"few": 4, "many": 19_999_996} and found.count("few") == 4 and 5 <= found.count("many") <= 24
    assert bounded_sample(rows.limit(50), "lang", "doc_id", 100)[0].count() == 50
