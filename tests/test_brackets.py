"""Quantiles by bracketed selection against sorted windows."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators.aggregate import aggregate, describe
from gridspark.operators.bins import quantile_bins
from gridspark.plans.ordered import bracketed_quantiles, exact_quantiles

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def shown(df):
    return sorted((str(r[:-1]), str(round(r[-1], 9)) if r[-1] is not None else "") for r in map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["ties", "normal", "hot", "nan"])
@pytest.mark.parametrize("accuracy", [60, 400, 10_000])
def test_equal_to_sorting(spark, kind, accuracy):
    rnd = random.Random(kind)
    make = {"ties": lambda: float(rnd.randint(0, 40)), "normal": lambda: rnd.gauss(0, 1e6),
            "hot": lambda: 7.0 if rnd.random() < .7 else rnd.random() * 20,
            "nan": lambda: rnd.choice([float("nan"), float("inf"), float("-inf"), 0.0, -0.0, None, rnd.random()])}[kind]
    rows = [(rnd.choice(["a", "a", "a", "b", None]), make()) for _ in range(4000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "value string, v double").repartition(4)
    plain = df.withColumnRenamed("value", "g")
    for by, null_groups in (([], False), (["g"], False), (["g"], True)):
        want = exact_quantiles(plain, "v", QS, by, null_groups=null_groups, strategy="window")
        assert shown(bracketed_quantiles(plain, "v", QS, by, null_groups, accuracy)) == shown(want)
    # the public aggregate takes any column name
    assert aggregate(df, ["value"], [("v", "median", "m")], strategy="brackets").count() == 5


def test_little_is_kept_and_no_value_is_shuffled_whole(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    from gridspark.plans import ordered
    seen = []
    real, ordered.materialize = ordered.materialize, lambda d, *a, **k: seen.append(real(d, *a, **k)) or seen[-1]
    try:
        got = bracketed_quantiles(df, "v", [0.25, 0.5]).collect()
    finally:
        ordered.materialize = real
    want = exact_quantiles(df, "v", [0.25, 0.5], strategy="window").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    kept = seen[0].where("_gap is null").count()
    assert kept <= 2 * (2 * 3 + 2) * 200_000 / 10_000 and seen[0].where("_gap is not null").count() == 3


def test_more_than_fits_a_task_goes_to_positions(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("v"))
    spark.conf.set("gridspark.singleTaskRows", "50")
    try:
        auto = exact_quantiles(df, "v", QS)
        assert shown(auto) == shown(exact_quantiles(df, "v", QS, strategy="window"))
        want = shown(exact_quantiles(df.groupBy("v").count().select("v"), "v", [.5], strategy="window"))
        assert shown(exact_quantiles(df, "v", [.5])) == want
    finally:
        spark.conf.unset("gridspark.singleTaskRows")


def test_rank_missed_by_the_sketch_is_still_right(spark, monkeypatch):
    from gridspark.plans import ordered
    real = F.percentile_approx
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda c, ps, a: F.transform(real(c, ps, a), lambda x: x * 0 + 3.0))
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    got = bracketed_quantiles(df, "v", [0.25, 0.5], accuracy=100)
    assert {r.q: r.value for r in got.collect()} == {0.25: 1249.75, 0.5: 2499.5}


def test_empty_table_and_described_columns(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert bracketed_quantiles(df, "v", [0.5], ["g"]).count() == 0
    assert [r["value"] for r in bracketed_quantiles(df, "v", [0.5]).collect()] == []
    rows = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(None).cast("int").alias("c"))
    assert shown(describe(rows, strategy="brackets")) == shown(describe(rows, strategy="window"))


def test_quantile_bins_plan_holds_the_edges_once(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(100)] + [(None, -1)], "`_e` double, c0 long")
    out = quantile_bins(df, "_e", 20)
    assert out.columns == ["_e", "c0", "_e_qbin", "_e_qbin_lo", "_e_qbin_hi"]
    got = {r["c0"]: (r["_e_qbin"], r["_e_qbin_lo"]) for r in out.collect()}
    assert got[0] == (1, 0.0) and got[99][0] == 20 and got[-1] == (None, None)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") <= 3


def bracket_plans(spark, monkeypatch, build):
    """Rows of ``build`` and the plans of the bracketed values, with tables too large to be broadcast unasked."""
    from gridspark.plans import ordered
    real, plans = ordered.materialize, []
    monkeypatch.setattr(ordered, "materialize", lambda d, *a, **k: plans.append(
        d._jdf.queryExecution().executedPlan().toString()) or real(d, *a, **k))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("gridspark.singleTaskRows", "1000")
    try:
        out = shown(build())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("gridspark.singleTaskRows")
    assert plans and not any("SortMergeJoin" in p for p in plans)
    return out


@pytest.mark.parametrize("strategy", ["auto", "brackets"])
def test_described_columns_are_not_gathered_by_column(spark, monkeypatch, strategy):
    df = spark.range(30_000).select((F.col("id") % 17_011).alias("a"), F.when(F.col("id") % 4 > 0, F.sqrt("id")).alias("b"),
                                    F.when(F.col("id") < 50, F.col("id")).alias("c"))
    got = bracket_plans(spark, monkeypatch, lambda: describe(df, strategy=strategy))
    assert got == shown(describe(df, strategy="positions"))


def test_hot_groups_are_not_gathered(spark, monkeypatch):
    df = spark.range(30_000).select((F.col("id") % 2).cast("string").alias("g"), F.when(
        F.col("id") % 3 == 0, 300.0).when(F.col("id") % 7 > 0, F.sqrt("id")).alias("v"))
    got = bracket_plans(spark, monkeypatch, lambda: exact_quantiles(df, "v", QS, ["g"], strategy="brackets"))
    assert got == shown(exact_quantiles(df, "v", QS, ["g"], strategy="positions"))


def test_medians_of_null_groups_are_not_gathered(spark, monkeypatch):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 9 / 100).alias("v"))
    specs = [("v", "median", "m"), ("v", "nunique", "n"), ("v", "count", "c")]
    got = bracket_plans(spark, monkeypatch, lambda: aggregate(df, ["g"], specs))
    assert got == shown(aggregate(df, ["g"], specs, strategy="positions")) and len(got) == 3
