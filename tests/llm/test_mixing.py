from collections import Counter

import pytest
from graphloom.llm.mixing import mix_plan, mix_sources, source_targets


def iterated(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The targets by sharing again and again, as the words say it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5000, "c": 10, None: 700}, {"x": 0, "y": 50}, {"a": 0}, {"é": 10, "z": 10, "Z": 1000, "zz": 3, None: 1}])
def test_targets(spark, sizes):
    out = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [3, 1, 2], 1.5, 2)
    assert sorted(round(r.target, 6) for r in out.collect()) == sorted(round(t, 6) for t in iterated(sizes).values())


def docs(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), "abc"[i % 3] if i % 10 else None, 5, 1.0 + i % 4) for i in range(600)]
    rows += [(1000, None, "a", 5, None), (1001, "", "a", 5, 1.0), (None, "no id", "b", 5, 1.0), (7, rows[7][1], rows[7][2], 5, 1.0), (1002, "long " * 20000, "d", 5, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, liking double")


def test_each_source_comes_near_its_target(spark):
    d = docs(spark)
    rows = mix_plan(d).collect()
    assert len(rows) == d.count() and all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rows)
    for key in {r.source_key for r in rows}:
        own = [r for r in rows if r.source_key == key]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 50 or key == "sd"
    again = mix_plan(d.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_preference_changes_the_odds(spark):
    rows = [(i, "w " * 20, "ab"[i % 2], 1.0 + 3 * (i // 2 % 2)) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, liking double")
    plan = mix_plan(d, weights=[1, 3], share=0.5, preference="liking").collect()
    mean = lambda source, liking: sum(r.copies for r in plan if r.source_key == source and rows[r.doc_id][3] == liking) / 200
    for source, target in (("sa", 0.25), ("sb", 0.75)):  # a target of so many copies each; odds of 1 to 4
        low, high = mean(source, 1.0), mean(source, 4.0)
        assert abs((low + high) / 2 - target) < 0.01 and abs(low - target * 0.4) < 0.08 and high > 2 * low


def test_nothing_is_left_that_fits(spark):
    """Sizes from 1 to 400: after the last pass no document of a source fits into what it lacks."""
    d = spark.createDataFrame([(i, "w " * (1 + i * 7919 % 400), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    rows = mix_plan(d).collect()
    for key in {r.source_key for r in rows}:
        own = [r for r in rows if r.source_key == key]
        lack = own[0].target - sum(r.taken for r in own)
        more = int(own[0].target / own[0].source_size) + (own[0].target % own[0].source_size > 0)  # copies that the odds allow
        assert lack >= 0 and not [r for r in own if r.copies < more and r.size <= lack]


def test_equal_rows_are_told_apart_by_number(spark):
    """100,000 equal rows without id: each is in the mix as often as its number says, by a join that grows with the rows, not with their square."""
    d = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one two three' AS text", "'a' AS source", "id % 7 AS extra")
    d = d.unionByName(spark.range(50_000).selectExpr("id AS doc_id", "'one two three' AS text", "'b' AS source", "0L AS extra"))
    plan = {(r.source_key, r.copies): r["count"] for r in mix_plan(d).groupBy("source_key", "copies").count().collect()}
    mixed = {r.source: r["count"] for r in mix_sources(d).groupBy("source").count().collect()}
    assert mixed == {s: sum(n * c for (k, c), n in plan.items() if k == "s" + s) for s in "ab"}
    assert abs(mixed["a"] - 168_750) <= 1 and abs(mixed["b"] - 56_250) <= 1


def test_the_mix_repeats_whole_rows(spark):
    d = docs(spark)
    plan, mixed = mix_plan(d).collect(), mix_sources(d)
    assert mixed.columns == d.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in Counter(x for r in plan for x in [r.doc_id] * r.copies).items() if n})


def test_no_rows(spark):
    assert mix_plan(docs(spark).limit(0)).count() == 0 and mix_sources(docs(spark).limit(0)).count() == 0
