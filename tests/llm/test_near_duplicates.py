import itertools
import random
import re

import numpy as np
import pytest
from graphloom.llm import near_duplicates as module
from graphloom.llm.near_duplicates import bands_for, near_duplicates
from graphloom.llm.shingles import band_keys, fast_similarity_sketch, shingle_hashes, word_hashes


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets[i] = shingles(text, width)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed=1, variants=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    texts = []
    for k in range(variants):  # a chain of near copies around the threshold
        words = base[:]
        for _ in range(rnd.randrange(0, 6)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join([rnd.choice(vocabulary) for _ in range(40)] + passage) for _ in range(40)]
    texts += ["Hello  World", "hello world", "hello\tworld\n", "one", "", "   ", None, "İ ß É", "i̇ ß é"]
    texts += [texts[3]] * 30 + [" ".join(rnd.choice(vocabulary) for _ in range(30_000))]
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("width,percent,block", [(3, 85, 1024), (5, 80, 8)])
def test_components_are_those_of_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(module, "BLOCK_DOCS", block)
    rows = corpus(width)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(rows[0][0], rows[0][1], "x", 1), (None, "null id text", "x", 1)], "doc_id long, text string, n_shingles string, kept int").repartition(3)
    out = near_duplicates(docs, width, percent).collect()
    assert len(out) == len(rows) + 2
    wanted = brute(rows, width, percent)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_order_of_rows_of_one_id_does_not_count(spark):
    """Ids that come with several texts have the links of all of them, whichever row is first."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = lambda t: t + " more"
    for rows, wanted in (
        ([(5, a), (5, b), (7, near(a)), (9, near(b))], {5: 5, 7: 5, 9: 5}),
        ([(5, b), (9, b), (9, a), (12, a), (12, "x y z"), (13, "x y z")], {5: 5, 9: 5, 12: 5, 13: 5}),
        ([(3, a), (4, b), (8, a), (8, b), (8, a)], {3: 3, 4: 3, 8: 3}),
        ([(3, a), (3, None), (4, ""), (4, near(a))], {3: 3, 4: 3}),
    ):
        for seed in range(2 if len(rows) == 4 and rows[0][1] == a and rows[1][1] == b else 1):
            mixed = rows[:]
            random.Random(seed).shuffle(mixed)
            out = near_duplicates(spark.createDataFrame(mixed, "doc_id long, text string").coalesce(1), 5, 80).collect()
            assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out if r.n_shingles} == set(wanted.items())


def test_crowded_bucket_of_one_large_component(spark, monkeypatch):
    """Blocks of the commonest component do not meet each other; links to the others are all found."""
    monkeypatch.setattr(module, "BLOCK_DOCS", 16)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(200):  # most are near the base; some lie a step further, linked with some of the near ones only
        words = base[:]
        for at in rnd.sample(range(100), 2 if i % 9 else 5):
            words[at] = f"v{rnd.randrange(6)}"
        rows.append((i, " ".join(words)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    wanted = brute(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == wanted and 1 < len({c for _, c in wanted.values()}) < 200


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_miss_less_than_one_in_a_million():
    for percent in (70, 80, 85, 90):
        bands, rows = bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


@pytest.mark.parametrize("n,both", [(10, 9), (50, 46), (500, 460), (20, 17)])
def test_pairs_at_the_threshold_share_a_band(n, both):
    """Sets of n with `both` in common, just above 80 or 85 % of their union; smaller and larger than the sketch."""
    rnd, missed = np.random.default_rng(n), 0
    percent = 85 if 100 * both >= 85 * (2 * n - both) else 80 if 100 * both >= 80 * (2 * n - both) else 70
    bands, rows = bands_for(percent)
    for _ in range(1500):
        members = rnd.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
        a, b = (band_keys(fast_similarity_sketch(np.sort(m), bands * rows), rows) for m in (members[:n], members[n - both :]))
        missed += not (a == b).any()
    assert missed == 0


def test_sketch_estimates_similarity():
    rnd = random.Random(3)
    errors = []
    for _ in range(40):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice((6, 40, 400)))]
        other = words[: int(len(words) * 0.8)] + [f"v{rnd.randrange(10**6)}" for _ in range(len(words) - int(len(words) * 0.8))]
        a, b = shingle_hashes(" ".join(words), 1), shingle_hashes(" ".join(other), 1)
        real = len(set(a) & set(b)) / len(set(a) | set(b))
        errors.append((fast_similarity_sketch(a, 128) == fast_similarity_sketch(b, 128)).mean() - real)
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_words_do_not_depend_on_the_pieces(monkeypatch):
    import graphloom.llm.shingles as s

    text = "Some words   and " + "x" * 500 + "\n more\twords " * 300
    whole = word_hashes(text)
    monkeypatch.setattr(s, "_PIECE", 64)
    assert (word_hashes(text) == whole).all() and len(whole) == len(text.split())
