"""Awkward inputs: null keys, colliding names, constant columns, dates in text."""

import datetime as dt

import pytest

from gridspark.functions.columns import resolve_column
from gridspark.functions.core import to_date
from gridspark.operators.aggregate import distinct_counts
from gridspark.operators.bins import quantile_bins
from gridspark.operators.clean import dedupe, fill_value, replace_first
from gridspark.operators.diff import table_diff
from gridspark.operators.filter import filter_rows
from gridspark.operators.pivot import crosstab, pivot_table
from gridspark.operators.project import page
from gridspark.session import checkpoint_dir
from gridspark.sources.io import export_rows, load_table


def test_pivot_keys_do_not_merge(spark):
    df = spark.createDataFrame([("r", "a_b", "c", 1), ("r", "a", "b_c", 10)], "k string, x string, y string, v long")
    with pytest.raises(ValueError, match="not unique"):
        pivot_table(df, "k", ["x", "y"], "v")
    out = pivot_table(df, "k", ["x", "y"], "v", sep="/")
    assert out.columns == ["k", "a/b_c", "a_b/c"] and tuple(out.first()) == ("r", 10, 1)


def test_pivot_on_doubles_and_odd_names(spark):
    df = spark.createDataFrame([(1, 1e-05, "a`b"), (1, 2.0, "c.d"), (2, 1e-05, "a`b")], "k long, d double, t string")
    out = crosstab(df, "k", "d", totals=True)
    assert out.columns == ["k", "1e-05", "2.0", "Total"]
    assert sorted(map(tuple, out.collect())) == [("1", 1, 1, 2), ("2", 1, 0, 1), ("Total", 2, 1, 3)]
    out = crosstab(df, "k", "t")
    assert out.columns == ["k", "a`b", "c.d"] and sorted(map(tuple, out.collect())) == [(1, 1, 1), (2, 1, 0)]


def test_constant_and_null_columns_have_no_quantile_bins(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "a double, b double")
    assert {tuple(r) for r in quantile_bins(quantile_bins(df, "a", 4), "b", 3).collect()} == {
        (5.0, None, None, None, None, None, None, None)}


def test_fill_all_columns_by_type(spark):
    df = spark.createDataFrame([(None,) * 5], "i int, d double, s string, t timestamp_ntz, b boolean")
    assert tuple(fill_value(df, 0).first()) == (0, 0.0, None, None, None)
    assert tuple(fill_value(df, 1.5).first()) == (None, 1.5, None, None, None)
    assert tuple(fill_value(df, "x").first()) == (None, None, "x", None, None)
    assert tuple(fill_value(df, True).first()) == (None, None, None, None, True)
    day = dt.datetime(2024, 1, 1)
    assert tuple(fill_value(df, day).first()) == (None, None, None, day, None)


def test_null_order_keys_are_last(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 2, "y"), ("b", None, "ring")], "k string, o long, v string")
    assert {tuple(r) for r in dedupe(df, ["k"], ["o"]).collect()} == {("a", 2, "y"), ("b", None, "ring")}
    two = spark.createDataFrame([(None, "ring"), (4, "ring")], "o long, v string")
    assert {tuple(r) for r in replace_first(two, "ring", "R", "v", ["o"]).collect()} == {(None, "ring"), (4, "R")}
    one = two.where("o is null")
    assert [tuple(r) for r in replace_first(one, "ring", "R", "v", ["o"]).collect()] == [(None, "R")]


def test_null_diff_key(spark):
    df = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    assert table_diff(df, df, "k").count() == 0


def test_pages_of_tied_and_null_keys(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(53)], "k long, v long")
    want = sorted(((r.v is None, r.v or 0, r.k) for r in df.collect()))
    got = [r.k for n in range(1, 8) for r in page(df, n, 8, ["v", "k"]).collect()]
    assert got == [k for _, _, k in want]
    assert [r.k for r in page(df, 99, 8, ["v", "k"]).collect()] == got[:8]
    assert page(df, 99, 8, ["v", "k"], reset_past_end=False).count() == 0


def test_text_ranges_of_dates_and_fuzzy_names(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 15, 31)], "t timestamp_ntz")
    assert filter_rows(df, "t", "between", "2024-01-02,2024-01-20").count() == 1
    assert filter_rows(df, "t", "between", "2024-01-01 to 2024-01-31").count() == 3
    assert resolve_column("custmer", ["customer", "order"], fuzzy=0.8) == "customer"
    with pytest.raises(KeyError):
        resolve_column("custmer", ["customer", "order"])


def test_wall_clock_times_that_a_zone_skips(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("junk",)], "s string")
        got = [r[0] for r in df.select(to_date("s", "yyyy-MM-dd HH:mm:ss")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [dt.datetime(2024, 3, 10, 2, 30), None]


def test_distinct_counts_are_typed(spark):
    long = "y" * 100
    df = spark.createDataFrame([(0.0, long), (-0.0, long + "z"), (float("nan"), None)], "d double, s string")
    assert dict(distinct_counts(df).collect()) == {"d": 2, "s": 2}


def test_export_has_no_cap_and_tables_of_a_database(spark, tmp_path):
    assert export_rows(spark.range(150_000), str(tmp_path / "e"), n=None).count() == 150_000
    assert export_rows(spark.range(150_000), str(tmp_path / "f"), n=120_000).count() == 120_000
    spark.sql("CREATE DATABASE IF NOT EXISTS gs_test LOCATION '" + str(tmp_path / "db") + "'")
    try:
        spark.range(3).write.mode("overwrite").saveAsTable("gs_test.t")
        assert load_table(spark, "gs_test.t").count() == 3
    finally:
        spark.sql("DROP DATABASE gs_test CASCADE")


def test_scratch_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
