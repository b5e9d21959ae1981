import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers
from graphloom.llm.packing import IdEncoder, best_two_fit, pack_documents, plan_bins

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_library():
    own, library, rnd = IdEncoder(FILE), tokenizers.Tokenizer.from_file(FILE), random.Random(4)
    alphabet = [*" ab.eth\n\t\r0½日é😀'\xa0", "<|endoftext|>", "'s", "'ll", "  ", " the", "\x00", "\x85", "\x1c", "᠎"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 14)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_very_long_white_space():
    own, library, n = IdEncoder(FILE), tokenizers.Tokenizer.from_file(FILE), 1_100_000
    for text in (" " * n, "a" + " " * n + "b c", "a \n" + "\n" * n + "b<|endoftext|>" + "\t \xa0\u3000" * (n // 4) + "?", "x" + " " * 600_000 + "yz" + " " * n + "\x1c"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_texts_of_ten_million_characters():
    own, n = IdEncoder(FILE), 10_000_000
    library = tokenizers.Tokenizer.from_file(FILE)
    for c in (" ", "\n", "a", "\u3000"):
        short = library.encode(c * 4096, add_special_tokens=False).ids
        ids = own.encode(c * n)
        assert ids[:1000] == short[:1000] and len(ids) >= n // 20, c


def test_long_pieces_are_merged_as_one_by_one():
    own, library, rnd = IdEncoder(FILE), tokenizers.Tokenizer.from_file(FILE), random.Random(8)
    for _ in range(400):
        text = "".join(rnd.choice([" ", "\n", "\t", "\r", "\xa0", "\u3000", "\n\n", "    "]) * rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 40)))
        assert own.merge_long(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_left_to_their_library(tmp_path):
    spec = json.loads(tokenizers.Tokenizer.from_file(FILE).to_str())
    changed = []
    for key, value in (("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", {**spec["pre_tokenizer"], "add_prefix_space": True}), ("model", {**spec["model"], "ignore_merges": True}), ("truncation", {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0})):
        file = tmp_path / f"{key}.json"
        file.write_text(json.dumps(spec | {key: value}))
        own, library = IdEncoder(str(file)), tokenizers.Tokenizer.from_file(str(file))
        library.no_truncation()
        changed.append(own.fast)
        for text in ("Hello World  again", "a<|endoftext|>b", ""):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert changed == [False, False, False, True]
    words = public_tokenizers.path("word_bpe_49k.json")
    own, library = IdEncoder(words), tokenizers.Tokenizer.from_file(words)
    assert not own.fast and own.encode("Hello  World") == library.encode("Hello  World", add_special_tokens=False).ids


def test_plan_holds_every_document_once():
    rnd = np.random.default_rng(6)
    for size, n in ((10, 50), (100, 400), (2048, 3000), (2048, 1), (7, 0)):
        lengths = np.minimum(size, rnd.geometric(4 / size, n)) if n else np.empty(0, int)
        counts = np.bincount(lengths, minlength=size + 1)
        held = np.zeros(size + 1, dtype=int)
        for times, lengths_ in plan_bins(counts, size):
            assert times > 0 and lengths_ and sum(lengths_) <= size
            for length in lengths_:
                held[length] += times
        assert (held == counts).all()
        bins = sum(t for t, _ in plan_bins(counts, size))
        assert bins <= -(-int((counts * np.arange(size + 1)).sum()) // size) * 1.2 + 1


def test_two_documents_replace_the_smallest():
    counts = np.zeros(101, dtype=int)
    counts[[60, 30, 21, 18]] = 1  # greedy 60 + 30 leaves 10; 60 + 21 + 18 leaves 1
    assert plan_bins(counts, 100)[0] == (1, [60, 21, 18])


def test_documents(spark):
    rows = [(1, "Hello world, " * 3, "s"), (1, "Hello world, " * 3, "s"), (2, None, "s"), (3, "", None), (None, "no id", "s"), (4, "many words here " * 3000, "s"), (5, "a<|endoftext|>b", "s")]
    rows += [(100 + i, f"word {i} " * (i % 37), "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = pack_documents(docs, FILE, 512).collect()
    library = tokenizers.Tokenizer.from_file(FILE)
    wanted = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 512 or 512, len(ids) + 1, 512)]
        wanted += [(i or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(wanted)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in out) // 512) + 2
    assert pack_documents(docs.limit(0), FILE).count() == 0


def test_lengths_of_one_size(spark):
    pieces = spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "3L AS length", "'x' AS extra")
    out = best_two_fit(pieces, 10).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 1000 and len({r.sequence_id for r in out}) == 334
