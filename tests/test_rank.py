import pytest
from pyspark.sql import functions as F

from gridspark.operators.rank import rank, top_n_ranked, top_percent
from gridspark.operators.rank import ranks as several_ranks
from gridspark.plans.ordered import exact_quantiles, row_numbers


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("Alice", 95), ("Bob", 85), ("Cara", 95), ("Diana", 90)],
                                 "name string, score long")


def ranks(df, col="score_rank"):
    return {r["name"]: r[col] for r in df.collect()}


@pytest.mark.parametrize("strategy", ["window", "positions"])
def test_score_ranks(scores, strategy):
    assert ranks(rank(scores, "score", "min", strategy=strategy)) == {"Alice": 1, "Bob": 4, "Cara": 1, "Diana": 3}
    assert ranks(rank(scores, "score", "dense", strategy=strategy)) == {"Alice": 1, "Bob": 3, "Cara": 1, "Diana": 2}
    assert ranks(rank(scores, "score", "max", strategy=strategy)) == {"Alice": 2, "Bob": 4, "Cara": 2, "Diana": 3}
    assert ranks(rank(scores, "score", "average", strategy=strategy)) == {
        "Alice": 1.5, "Bob": 4.0, "Cara": 1.5, "Diana": 3.0}
    assert ranks(rank(scores, "score", "percentile", strategy=strategy)) == {
        "Alice": 0.375, "Bob": 1.0, "Cara": 0.375, "Diana": 0.75}


@pytest.mark.parametrize("strategy", ["window", "positions"])
def test_nulls_rank_null_and_groups(ties, strategy):
    r = rank(ties, "v", "min", group="g", ascending=True, strategy=strategy)
    got = {x["k"]: x["v_rank"] for x in r.collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 1, 6: 1, 7: None, 8: None, 9: 3}
    p = rank(ties, "v", "percentile", group="g", ascending=True, strategy=strategy)
    got = {x["k"]: x["v_rank"] for x in p.collect()}
    assert got[9] == 1.0 and got[5] == pytest.approx(0.5) and got[7] is None


def test_rank_order_invariants(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    r = rank(rank(rank(df, "l_quantity", "min", name="a"), "l_quantity", "average", name="b"),
             "l_quantity", "max", name="c")
    assert r.where("NOT (a <= b AND b <= c)").count() == 0


def test_positions_equal_window_on_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    for m in ("min", "dense", "max"):
        a = rank(df, "l_extendedprice", m, group="l_returnflag", strategy="window", name="r")
        b = rank(df, "l_extendedprice", m, group="l_returnflag", strategy="positions", name="r")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_positions_plan_has_no_single_partition_window(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = rank(df, "l_quantity", "min", strategy="positions")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan.lower()
    assert "PythonUDF" not in plan


def test_hot_key_uses_many_buckets(spark):
    # one value holds a third of the rows: collapsed to one counted row
    hot = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
    r = rank(hot, "v", "min", ascending=True, strategy="positions")
    assert r.where("v = 7").select(F.countDistinct("v_rank")).first()[0] == 1
    assert r.where("v = 7").first()["v_rank"] == 5  # ids 1, 2, 4, 5 come first


def test_top_n_keeps_ties(ties):
    out = top_n_ranked(ties, "v", 1, "min", group="g")
    assert sorted(r["k"] for r in out.collect()) == [4, 9]
    out2 = top_n_ranked(ties, "v", 2, "dense", group="g", ascending=True)
    assert sorted(r["k"] for r in out2.collect()) == [1, 2, 3, 5, 6, 9]


def test_top_n_plan_uses_group_limit(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = top_n_ranked(df, "o_totalprice", 3, "first", group="o_custkey", tiebreak=["o_orderkey"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_top_percent(spark):
    df = spark.range(1, 101).select(F.col("id").alias("v"))
    assert top_percent(df, "v", 10).count() == 10
    assert sorted(r["v"] for r in top_percent(df, "v", 3, ascending=True).collect()) == [1, 2, 3]


@pytest.mark.parametrize("strategy", ["window", "positions"])
def test_row_numbers_unique(spark, strategy):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v long")
    r = row_numbers(df, ["v"], name="n", strategy=strategy)
    assert sorted((x["v"], x["n"]) for x in r.collect() if x["v"] is not None) == [(1, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("strategy", ["window", "positions"])
def test_exact_quantiles_interpolate(spark, strategy):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    q = {r["q"]: r["value"] for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0], strategy=strategy).collect()}
    assert q == {0.0: 1.0, 0.25: 1.75, 0.5: 2.5, 1.0: 4.0}


def test_row_numbers_after_a_shuffle(spark):
    # input with a shuffle: the hidden ids are materialised before numbering
    df = spark.range(0, 2000).select((F.col("id") % 7).alias("g"), (F.col("id") % 11).alias("v")) \
        .groupBy("g", "v").count()
    r = row_numbers(df, ["v"], by=["g"], name="n", strategy="positions")
    got = r.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c"))
    assert got.where("lo != 1 OR hi != c").count() == 0


def test_forced_window_leaves_large_groups_to_slices(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id") % 700).alias("v"), "id")
    shown = lambda d: sorted(map(str, d.collect()))
    ways = [lambda: several_ranks(df, "v", {"a": "min", "b": "dense", "c": "max"}, strategy="window"),
            lambda: rank(df, "v", "min", group="g", strategy="window")]
    for way in ways:
        want = shown(way())
        spark.conf.set("gridspark.singleTaskRows", "100")
        try:
            got = way()
            # ``_alone`` is the mark of a window over whole groups
            assert "_alone" not in got._jdf.queryExecution().analyzed().toString()
            assert shown(got) == want
        finally:
            spark.conf.unset("gridspark.singleTaskRows")
        assert "_alone" in way()._jdf.queryExecution().analyzed().toString()
