import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import tokenizers

ROOT = Path(__file__).resolve().parents[2]


def test_stages_on_a_small_corpus(spark, tmp_path):
    import random

    rnd = random.Random(1)
    vocabulary = {"en": "the of and to house river water stone".split(), "fr": "le la les et maison rivière pierre eau".split()}
    rows, labels = [], []
    for i in range(200):
        lang = ("en", "fr")[i % 2]
        words = [rnd.choice(vocabulary[lang]) for _ in range(40)] + [f"x{chr(97 + i % 26)}{chr(97 + i // 26)}"]
        if i % 9 == 0:
            words[5] = "idiotic"
            words[9] = "wretch"
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 9 == 0)))
    rows += [(8, " ".join(rnd.choice(vocabulary["en"]) for _ in range(40)), "en", "s2", 1)]  # another text under an id
    rows += [(500 + i, rows[10][1], "en", "s1", 1) for i in range(5)] + [(600, None, "en", None, 0), (601, "12 34 !", "en", "s0", 0), (602, "", None, "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS _language", "2 AS _Severity", "3 AS _text"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(docs)
        if name != "packing":
            assert docs.columns == columns
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert ids[0] == sorted(r[0] for r in rows if r[0] < 600)
    assert ids[1] == [i for i in ids[0] if i >= 500 or i % 9]
    assert ids[2] == [i for i in ids[1] if i < 500]
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) > len(set(ids[3]))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[3].collect())
    assert seen[4].agg({"length": "sum"}).first()[0] == total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_library_stands_without_this_subpackage(spark, tmp_path):
    for name in ("graphloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "graphloom/llm")], check=True)
    spark.createDataFrame([(1, "Wind causes rain. However, it stops.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    code = "import __spark_entry__ as e; print([q for q in e.queries() if q.startswith('op') or q == 'pipeline']); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').getOrCreate(); print(sorted((r.edge_type, r.sentences) for r in e.queries()['edge_type_classify'](s, '.').collect()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.splitlines()[-2:] == ["[]", "[('contrastive', 1), ('semantic', 1)]"], out.stderr
