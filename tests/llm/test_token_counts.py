import random

import public_tokenizers
import pytest
import sentencepiece
from graphloom.llm.token_counts import PrefixCounter, prefix_tables, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, n_tokens int, prefix_counts int"


def texts():
    rnd = random.Random(5)
    alphabet = [*" ▁ab.ethn\n\t\r0日本é😀", "<s>", "<unk>", "  ", " the", " of ", "\x00", "ﬁ"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 16))) for _ in range(600)] + ["Words, and more words.\n" * 20, "x" * 3000, " " * 50]


def test_counts_are_those_of_the_library():
    own, library = PrefixCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [own.count(t) for t in texts()] == [len(library.encode(t)) for t in texts()]


def test_every_prefix_and_the_longest_within_a_budget():
    own, library = PrefixCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in [t for t in texts() if len(t) < 300][:150] + ["The idea of 日本 is\n\nstrengthening $$$ ideas" * 3]:
        counts = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert own.prefix_counts(text).tolist() == counts
        for budget in (0, 1, 4, 9):
            assert own.longest_prefix(text, budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_pairs_that_stay_apart_are_those_of_the_merges():
    own, rnd = PrefixCounter(MODEL), random.Random(2)
    pieces = [p for p in rnd.sample(sorted(own.score), 3000) if own.merged(p) == [p]]
    for a, b in zip(pieces[::2], pieces[1::2], strict=False):
        assert own._fits(a, b) == (own.merged(a + b) == [a, b])


def test_rows_as_they_come(spark):
    rows = [(1, "Hello world", "s", 0, 0), (1, "Hello world", "s", 0, 0), (2, None, None, 0, 0), (None, "", "s", 0, 0), (3, "long text " * 5000, "s", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = token_counts(docs, MODEL, limit=4096).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in out) == [(0, 0, False), (1, 11, False), (1, 11, False), (2, 0, False), (3, 50000, True)]
    long = next(r for r in out if r.doc_id == 3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert long.n_tokens == len(library.encode("long text " * 5000))
    assert len(library.encode(("long text " * 5000)[: long.fit_chars])) <= 4096 < len(library.encode(("long text " * 5000)[: long.fit_chars + 1]))
    tables = {r.doc_id: r.prefix_counts for r in prefix_tables(docs.where("doc_id < 3"), MODEL).collect()}
    assert tables[2] == [0] and tables[1][-1] == len(library.encode("Hello world"))
    assert token_counts(docs.limit(0), MODEL).count() == 0


def test_models_that_do_more_are_refused(tmp_path):
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    for change in ("white space", "lower case", "user's pieces"):
        with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            model.ParseFromString(f.read())
        if change == "white space":
            model.normalizer_spec.remove_extra_whitespaces = True
        elif change == "lower case":
            model.normalizer_spec.name = "nmt_nfkc"
            model.normalizer_spec.add_dummy_prefix = False
            model.normalizer_spec.remove_extra_whitespaces = True
        else:
            model.pieces[31990].type, model.pieces[31990].piece, model.pieces[31990].score = 4, "zqxj", 0
        file = tmp_path / "changed.model"
        file.write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            PrefixCounter(str(file))
