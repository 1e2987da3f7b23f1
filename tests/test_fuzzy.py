import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators.fuzzy import (filter_fuzzy_table, fuzzy_join_table, fuzzy_pairs, fuzzy_replace_from, gram_size)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def score(a, b):
    n = max(len(a), len(b))
    return 100.0 if not n else 100.0 * (1.0 - edits(a, b) / n)


def changed(rnd, text, letters):
    out = list(text)
    for _ in range(rnd.randint(0, 4)):
        at = rnd.randint(0, len(out))
        kind = rnd.randint(0, 2)
        if kind == 0:
            out.insert(at, rnd.choice(letters))
        elif out:
            at = min(at, len(out) - 1)
            if kind == 1:
                out[at] = rnd.choice(letters)
            else:
                del out[at]
    return "".join(out)


@pytest.mark.parametrize("threshold", [30.0, 50.0, 60.0, 66.7, 75.0, 80.0, 90.0, 100.0])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh é"])
def test_index_finds_every_pair(spark, threshold, letters):
    rnd = random.Random(threshold)
    right = {"".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(60)}
    left = {changed(rnd, rnd.choice(sorted(right)), letters) for _ in range(60)} | {"", "a" * 30}
    frames = [spark.createDataFrame([(t,) for t in sorted(s)], "low string") for s in (left, right)]
    got = {(r.a, r.b): r.score for r in fuzzy_pairs(*frames, threshold).collect()}
    want = {(a, b) for a in left for b in right if score(a, b) >= threshold - 1e-9}
    assert set(got) == want
    assert all(abs(got[p] - score(*p)) < 1e-9 for p in got)


def test_gram_size_never_lets_all_grams_be_destroyed():
    assert [gram_size(t) for t in (10, 49, 50, 60, 67, 80, 100)] == [1, 1, 2, 2, 3, 3, 3]


def test_best_match_ties_nulls_case_and_clashing_names(spark):
    left = spark.createDataFrame([("Gren", 1), ("gren", 2), ("Gren", 3), (None, 4), ("zzzzzz", 5)], "match string, value long")
    right = spark.createDataFrame([("green",), ("Grenz",), ("greno",), (None,), ("green",)], "score string")
    got = {tuple(r) for r in fuzzy_join_table(left, "match", right, "score", 75).collect()}
    assert got == {("Gren", "Grenz", 80.0, 2), ("gren", "Grenz", 80.0, 1), ("zzzzzz", None, None, 1)}
    every = fuzzy_join_table(left, "match", right, "score", 75, best=False)
    assert every.count() == 6
    out = fuzzy_replace_from(left, "match", right, "score", 75)
    assert {tuple(r) for r in out.collect()} == {("Grenz", 1), ("Grenz", 2), ("Grenz", 3), (None, 4), ("zzzzzz", 5)}
    assert {r["value"] for r in filter_fuzzy_table(left, "match", right, "score", 75).collect()} == {1, 2, 3}
    assert fuzzy_join_table(left.limit(0), "match", right, "score").count() == 0
    assert fuzzy_join_table(left, "match", right.limit(0), "score").where("match is not null").count() == 0


def test_no_cross_join_and_no_hinted_broadcast(spark):
    df = spark.range(1000).select(F.concat(F.lit("name "), F.col("id")).alias("t"))
    plan = fuzzy_join_table(df, "t", df, "t", 90)._jdf.queryExecution().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "strategy=broadcast", "PythonUDF"):
        assert word not in plan
    with pytest.raises(ValueError):
        fuzzy_join_table(df, "t", df, "t", 0)


@pytest.mark.parametrize("way", [fuzzy_replace_from, fuzzy_join_table, filter_fuzzy_table])
def test_few_texts_with_many_pairs_are_met_by_many_tasks(spark, way):
    words = spark.range(400).select(F.concat(F.lit("old "), F.col("id") % 20, F.lit(" plate "), F.col("id")).alias("low"))
    refs = words.select(F.replace("low", F.lit("plate"), F.lit("plates")).alias("ref"))
    found = way(words, "low", refs, "ref", 85)
    assert found.count() == 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2     # not put together by their few bytes
    assert any("levenshtein" in line for line in plan.splitlines() if "Join" in line)
