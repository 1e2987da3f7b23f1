import datetime as dt


from gridspark.operators import bins as B
from gridspark.operators import issues as I
from gridspark.operators import outliers as U
from gridspark.operators import profile as P
from gridspark.operators import text as L
from gridspark.operators import timeseries as T
from gridspark.operators.diff import diff_summary, table_diff
from gridspark.operators.search import fuzzy_search, search_all, suggest_values


def by_v(df, col):
    return {r["v"]: r[col] for r in df.collect()}


def test_equal_width_bins_right_closed(edges):
    got = by_v(B.equal_width_bins(edges, "v", 5, name="b"), "b")
    # edges 0, 2.2, 4.4, 6.6, 8.8, 11: (lo, hi], first bin closed
    assert got == {0.0: 1, 2.0: 1, 5.0: 3, 10.0: 5, 11.0: 5}


def test_equal_width_all_equal(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert by_v(B.equal_width_bins(df, "v", 5, name="b"), "b") == {5.0: 3}


def test_custom_bins_outside_null(edges):
    got = by_v(B.custom_bins(edges, "v", [0, 5, 10], name="b"), "b")
    assert got == {0.0: 1, 2.0: 1, 5.0: 1, 10.0: 2, 11.0: None}
    lab = by_v(B.custom_bins(edges, "v", [0, 5, 10], labels=["lo", "hi"], name="b"), "b")
    assert lab[10.0] == "hi"


def test_quantile_bins_drop_duplicate_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3, 4, 5]], "v double")
    got = by_v(B.quantile_bins(df, "v", 4, name="b"), "b")
    assert got[1.0] == 1 and got[5.0] == max(got.values())


def test_outliers(spark):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in [1, 2, 3, 4, 5, 100, None]], "v double")
    assert U.outliers(df, "v", "iqr").count() == 1
    assert U.outliers(df, "v", "iqr", keep="remove").count() == 6  # null is never an outlier
    s = U.outlier_summary(df, "v", "iqr").first()
    assert (s["outliers"], s["rows"]) == (1, 7)
    assert U.outliers(df, "v", "bounds", lower=2, upper=5).count() == 2


def test_zscore_constant_has_none(consts):
    assert U.outliers(consts, "c", "zscore").count() == 0


def test_period_weeks_start_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 5),), (dt.datetime(2024, 3, 11, 5),), (None,)],
                               "ts timestamp_ntz")
    got = sorted(r["period"] for r in T.period_aggregate(df, "ts", "week").collect())
    assert got == [dt.datetime(2024, 3, 4), dt.datetime(2024, 3, 11)]


def test_semantic_types(spark, flags):
    got = {r["column"]: r["semantic_type"] for r in P.detect_types(flags).collect()}
    assert got == {"k": "ID (Unique)", "yn": "Flag (Yes/No)", "b01": "Flag (0/1)", "b": "Flag (Boolean)"}
    df = spark.createDataFrame([(i, f"u{i}@mail.com" if i < 20 else "x", f"2024-01-{(i % 28) + 1:02d}", str(i % 3))
                                for i in range(40)], "id long, mail string, d string, n string")
    got = {r["column"]: r["semantic_type"] for r in P.detect_types(df).collect()}
    assert got["mail"] == "Email" and got["d"] == "Date-like string" and got["n"] == "Category (3 values)"


def test_missing_report_status(nulls, spark):
    got = {r["column"]: r["status"] for r in P.missing_report(nulls).collect()}
    assert got["k"] == "Clean" and got["g"] == "Some Missing" and got["t"] == "Some Missing"
    empty = spark.createDataFrame([(None,), (None,)], "e string")
    assert P.missing_report(empty).first()["status"] == "All Empty"


def test_top_values_ties_by_value(ties):
    got = [(r["value"], r["count"]) for r in P.top_values(ties, ["v"], k=2).orderBy("rank").collect()]
    assert got == [("20", 4), ("10", 1)]


def test_issue_scan_float_ids(spark):
    df = spark.createDataFrame([(1e15 + i, None if i else "z") for i in range(12)], "id double, sparse string")
    got = {(r["column"], r["issue"]) for r in I.issue_scan(df).collect()}
    assert ("id", "float_id_precision") in got and ("id", "unique_values") in got
    assert ("sparse", "high_nulls") in got
    fixed = I.apply_fix(df, "id", "float_id_precision")
    assert dict(fixed.dtypes)["id"] == "bigint"


def test_text_tools(spark):
    df = spark.createDataFrame([(" Ab",), ("ab ",), ("AB",), ("ab",), ("12",), (None,)], "s string")
    r = L.text_issues(df, "s").first()
    assert (r["leading_spaces"], r["trailing_spaces"], r["case_variants"]) == (1, 1, True)
    chars = [x["char"] for x in L.top_chars(df, "s", 2).collect()]
    assert chars == ["A", "b"] or chars == ["b", "A"] or len(chars) == 2
    assert L.text_lengths(df, "s").first()["max_len"] == 3


def test_search_and_fuzzy(spark):
    df = spark.createDataFrame([(1, "apple pie"), (2, "Banana"), (3, "grape")], "k long, s string")
    assert search_all(df, "APP").count() == 1 and search_all(df, "2").count() == 1
    top = fuzzy_search(df, "s", "banana", k=1).first()
    assert top["value"] == "Banana" and top["score"] == 100.0
    sug = {r["value"]: r["match"] for r in suggest_values(df, "s", ["apple", "grapes"]).collect()}
    assert sug["grape"] == "grapes" and sug["Banana"] is None


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", None)], "id long, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 5.0), (4, "w", 1.0), (3, "z", None)], "id long, s string, v double")
    got = {r["id"]: (r["status"], r["changed_cells"]) for r in table_diff(a, b, "id").collect()}
    assert got == {2: ("changed", 1), 4: ("added", 2)}
    s = diff_summary(a, b, "id").first()
    assert (s["rows_before"], s["rows_after"], s["added"], s["removed"], s["changed"]) == (3, 4, 1, 0, 1)


def test_approximate_modes_run(spark):
    from gridspark.operators import aggregate as A
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    d = {r["column"]: r for r in A.describe(li, ["l_quantity"], exact=False).collect()}
    assert 1 <= d["l_quantity"]["p50"] <= 50
    assert B.quantile_bins(li, "l_quantity", 4, exact=False).where("l_quantity_qbin IS NULL").count() == 0
    assert U.outliers(li, "l_extendedprice", "iqr", exact=False).count() >= 0
    assert A.distinct_counts(li, ["l_returnflag"], exact=False).first()["n_distinct"] == 3
    assert P.profile(spark.read.parquet("/root/testdata/sf0.001/customer.parquet"), exact=False).count() == 5
