import pytest
from pyspark.sql import functions as F

from gridspark.operators import aggregate as A
from gridspark.operators.pivot import crosstab, pivot_table


def test_sum_of_all_null_group_is_zero_and_median_null(nulls):
    df = nulls.withColumn("v2", F.when(F.col("g") == "b", None).otherwise(F.col("v")))
    got = {r["g"]: r["Sum_v2"] for r in A.sum_by(df, "g", "v2").collect()}
    assert got["b"] == 0 and got[None] == 5.0
    med = {r["g"]: r["median_v2"] for r in A.custom_agg(df, "v2", "median", key="g").collect()}
    assert med["b"] is None and med["a"] == 4.0


def test_count_vs_size(nulls):
    out = A.aggregate(nulls, ["g"], [("v", "count", "n"), ("v", "size", "rows")])
    got = {r["g"]: (r["n"], r["rows"]) for r in out.collect()}
    assert got == {"a": (2, 3), "b": (2, 2), None: (1, 2)}


def test_unknown_aggregate_rejected(nulls):
    with pytest.raises(ValueError):
        A.custom_agg(nulls, "v", "__import__")


def test_avg_rounds_half_even(spark):
    df = spark.createDataFrame([("a", 0.125), ("a", 0.125)], "k string, v double")
    assert A.avg_by(df, "k", "v").first()["Avg_v"] == 0.12


def test_corr_constant_column_is_null(consts):
    m = {r["column"]: r for r in A.corr_matrix(consts).collect()}
    assert m["a"]["a"] == pytest.approx(1.0)
    assert m["a"]["c"] is None


def test_describe_matches_definition(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "v double")
    r = A.describe(df).first()
    assert (r["count"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (5, 1.0, 2.0, 3.0, 4.0, 100.0)


def test_value_counts_excludes_nulls(nulls):
    got = [(r["g"], r["count"]) for r in A.value_counts(nulls, "g").collect()]
    assert got == [("a", 3), ("b", 2)]


def test_null_counts(nulls):
    got = {r["column"]: r["nulls"] for r in A.null_counts(nulls).collect()}
    assert got == {"k": 0, "g": 2, "v": 2, "t": 1}


def test_pivot_fills_zero_and_drops_null_keys(ties):
    out = pivot_table(ties, "g", "k", "v", "sum", values=[1, 2, 5])
    got = {r["g"]: (r["1"], r["2"], r["5"]) for r in out.collect()}
    assert got == {"x": (10, 20, 0), "y": (0, 0, 20)}


def test_crosstab_totals(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("b", None)], "r string, c string")
    out = {r["r"]: (r["x"], r["y"], r["Total"]) for r in crosstab(df, "r", "c", totals=True).collect()}
    assert out == {"a": (1, 1, 2), "b": (1, 0, 1), "Total": (2, 1, 3)}


def test_pivot_total_equals_group_total(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    p = pivot_table(li, "l_returnflag", "l_linestatus", "l_quantity", "sum")
    tot = p.select(F.sum(F.col("F") + F.col("O"))).first()[0]
    assert tot == pytest.approx(li.select(F.sum("l_quantity")).first()[0])


def test_pivot_value_cap(ties):
    with pytest.raises(ValueError):
        pivot_table(ties, "g", "k", "v", max_values=3)
