"""The registered queries over small tables: against DuckDB where there is SQL, else against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import __spark_entry__
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

NAMES = "op1_token_counts op2_language_id op3_minhash_near_dedup op4_media_columns op5_best_two_fit_packing op6_toxicity op7_warc_salvage op8_pareto_mixing op9_url_filters op10_nearest_neighbours pipeline".split()
WORDS = {"en": "the of and to house river water stone idea light".split(), "fr": "le la les et maison rivière pierre eau être ça".split(), "de": "der die das und haus fluß wasser straße über nicht".split()}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, rnd = tmp_path_factory.mktemp("tables"), random.Random(11)
    rows, labels = [], []
    for i in range(240):
        lang = sorted(WORDS)[i % 3]
        words = [rnd.choice(WORDS[lang]) + rnd.choice(["", "", ",", ".", "x%d" % rnd.randrange(99)]) for _ in range(rnd.choice([3, 20, 60, 200]))]
        if i % 8 == 0:
            words[1:1] = ["dreadful", "vermin"]
        rows.append((i, " ".join(words), lang, f"src{i % 4}" if i % 20 else None, 0))
        labels.append((i, 1, int(i % 8 == 0)))
    for i in range(240, 270):
        text = rows[rnd.randrange(0, 240)][1]
        rows.append((i, text if i % 2 else text + " tail", "en", "src0", 0))
    rows += [(300, None, "en", "src1", 0), (301, "", "fr", "src1", 0), (302, "Long words " * 4000, "en", "src2", 0), (303, "<|endoftext|> <s> 日本\n\t ok", None, "src3", 0)]
    put = lambda name, frame: frame.to_parquet(f"{folder}/{name}.parquet")
    put("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    put("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    hosts = ["a.example.com", "b.example.org", "x.y.example.net", "m.z.example.com"]
    pages = [(i, f"https://{hosts[i % 4]}/{'en' if i % 3 else 'fr'}/{i}?q", None if i == 7 else f"<p>{i // 3 if i % 2 else i} é</p>") for i in range(60)]
    put("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    vectors = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    vectors[50:120] = vectors[3]
    put("embeddings", pd.DataFrame({"vec_id": range(400), "embedding": list(vectors), "label": [i % 5 for i in range(400)]}))
    return str(folder)


def result(spark, tables, name):
    return __spark_entry__.queries()[name](spark, tables).toPandas()


def documents(tables):
    return {r.doc_id: r.text or "" for r in pd.read_parquet(f"{tables}/documents.parquet").itertuples()}


def test_every_query_is_registered():
    assert set(NAMES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in __spark_entry__.oracle_sql()])
def test_sql(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    wanted, found = db.execute(__spark_entry__.oracle_sql()[name]).df(), result(spark, tables, name)
    rows = lambda f: sorted(str(tuple(None if pd.isna(v) else (round(float(v), 9) if isinstance(v, float | np.floating | int | np.integer) and not isinstance(v, bool | np.bool_) else str(v)) for v in r)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(found) == rows(wanted)


def test_op1(spark, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts, found = documents(tables), result(spark, tables, "op1_token_counts")
    assert len(found) == len(texts)
    for r in found.itertuples():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_op2(spark, tables):
    found = result(spark, tables, "op2_language_id").merge(pd.read_parquet(f"{tables}/documents.parquet"), on="doc_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.itertuples())
    own = found[found.held_out & (found.doc_id < 240)]
    assert len(own) > 40 and (own.lang_pred == own.lang).mean() > 0.85
    assert set(found[found.doc_id.isin([300, 301])].lang_pred) == {"und"} and found.score.between(0, 1).all()


def test_op4(spark, tables):
    texts, found = documents(tables), result(spark, tables, "op4_media_columns")
    for r in found.itertuples():
        data = texts[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len(found) == len(texts) and found.groupby("media_sha256").feature.nunique().max() == 1


@pytest.mark.parametrize("name", ["op5_best_two_fit_packing", "pipeline"])
def test_packings(spark, tables, name):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts, found = documents(tables), result(spark, tables, name)
    bins, copies = defaultdict(list), defaultdict(int)
    for r in found.itertuples():
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        if r.piece == 0:
            copies[r.doc_id] += 1
            assert r.start == 0 and r.length == (len(ids) % 2048 or 2048)
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= -(-found.length.sum() // 2048) + 2
    assert set(copies.values()) == {1} and set(copies) == set(texts) if name != "pipeline" else max(copies.values()) <= 2


def test_op6(spark, tables):
    found = result(spark, tables, "op6_toxicity")
    assert len(found) == len(documents(tables))
    assert all(r.toxic == (r.doc_id % 8 == 0) for r in found.itertuples() if r.doc_id < 240)


def test_op10(spark, tables):
    frame = pd.read_parquet(f"{tables}/embeddings.parquet")
    v = np.stack(frame.embedding).astype(float)
    found = result(spark, tables, "op10_nearest_neighbours").set_index(["query_id", "rank"]).sort_index()
    hits = []
    for q in range(0, 400, 20):
        score = (v * v[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        own = found.loc[q]
        assert list(own.index) == list(range(1, 21)) and np.allclose(own.score, score[own.vec_id], rtol=0, atol=1e-12)
        hits.append(len(set(best) & set(own.vec_id)) / 20)
    assert np.mean(hits) >= 0.9
