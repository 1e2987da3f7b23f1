
from gridspark.operators.filter import (filter_expr, filter_flag, filter_fuzzy_value, filter_multi,
                                        filter_rows, filter_stack, flag_columns, predicate)



def keys(df):
    return sorted(r[0] for r in df.select("k").collect())


def test_blank_matches_null_and_whitespace(nulls):
    assert keys(filter_rows(nulls, "t", "is blank")) == [2, 3, 4, 5]
    assert keys(filter_rows(nulls, "t", "is not blank")) == [1, 6, 7]


def test_text_nan_and_none_are_values_not_nulls(nulls):
    assert keys(filter_rows(nulls, "t", "==", "nan")) == [6]
    assert keys(filter_rows(nulls, "t", "is null")) == [2]


def test_negated_operators_keep_nulls(nulls):
    assert keys(filter_rows(nulls, "g", "!=", "a")) == [2, 3, 5, 6]
    assert keys(filter_rows(nulls, "g", "not contains", "A")) == [2, 3, 5, 6]
    assert keys(filter_rows(nulls, "g", "not in", "a")) == [2, 3, 5, 6]
    assert keys(filter_rows(nulls, "g", "==", "a")) == [1, 4, 7]


def test_filter_and_complement_cover_table(nulls):
    p = predicate(nulls, "v", ">", 3)
    assert nulls.where(p).count() + nulls.where(~p).count() == nulls.count()


def test_numeric_comparisons_and_between(nulls):
    assert keys(filter_rows(nulls, "v", ">", "3")) == [5, 6, 7]
    assert keys(filter_rows(nulls, "v", "between", "3-6")) == [3, 5, 6]
    assert keys(filter_rows(nulls, "v", "between", (1, 3))) == [1, 3]


def test_in_numeric_list_on_text_column(spark):
    df = spark.createDataFrame([(1, "1"), (2, "2.0"), (3, "x"), (4, None)], "k long, s string")
    assert keys(filter_rows(df, "s", "in", "1, 2")) == [1, 2]


def test_contains_literal_vs_regex(regex_frame):
    assert keys(filter_rows(regex_frame, "t", "contains", "a.b")) == [1, 3]
    assert keys(filter_rows(regex_frame, "t", "contains", "a.b", regex=True)) == [1, 3, 6]
    assert keys(filter_rows(regex_frame, "t", "contains", "$1")) == [2]
    assert keys(filter_rows(regex_frame, "t", "starts with", "A")) == [3]


def test_filter_age_over_28(spark):
    df = spark.createDataFrame([("Alice", 25, "NYC"), ("Bob", 30, "LA"), ("Cara", 35, "SF")],
                               "name string, age long, city string")
    assert filter_rows(df, "age", ">", 28).count() == 2


def test_multi_condition_left_to_right(ties):
    # ((v >= 20 AND g == 'x') OR k == 8) evaluated strictly left to right
    out = filter_multi(ties, [("v", ">=", 20), ("g", "==", "x", "and"), ("k", "==", 8, "or")])
    assert keys(out) == [2, 3, 4, 8]
    out2 = filter_multi(ties, [("k", "==", 8), ("v", ">=", 20, "or"), ("g", "==", "x", "and")])
    assert keys(out2) == [2, 3, 4]


def test_stack_skips_unknown_columns(ties):
    out = filter_stack(ties, [("g", "==", "y"), ("gone", "==", 1), ("v", ">", 20)])
    assert keys(out) == [9]


def test_flags(flags):
    found = {r["column"]: r for r in flag_columns(flags).collect()}
    assert set(found) == {"yn", "b01", "b"}
    assert keys(filter_flag(flags, "yn", True)) == [1, 3, 5]
    assert keys(filter_flag(flags, "b01", False)) == [2, 4, 7]
    assert keys(filter_flag(flags, "b", True)) == [1, 3, 6, 7]


def test_expression_filter(ties):
    assert keys(filter_expr(ties, "v == 20 and g = 'y'")) == [5, 6]


def test_fuzzy_value_snaps_to_nearest(spark):
    df = spark.createDataFrame([(1, "apple"), (2, "banana"), (3, "apple"), (4, "grape")], "k long, f string")
    assert keys(filter_fuzzy_value(df, "f", "aple")) == [1, 3]
    assert filter_fuzzy_value(df, "f", "zzzzzz").count() == 0


def test_filters_stay_jvm_side(ties):
    plan = filter_rows(ties, "g", "contains", "x")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
