import datetime as dt

import pytest

from gridspark.operators import clean as C
from gridspark.operators import derive as X


def col(df, name, key="k"):
    return {r[key]: r[name] for r in df.collect()}


def test_money_to_int_and_float(money):
    ints = col(C.cast_column(money, "raw", "int"), "raw")
    assert ints == {1: None, 2: 12, 3: 7, 4: None, 5: None, 6: None, 7: 1000}
    rounded = col(C.cast_column(money, "raw", "int", on_fraction="round"), "raw")
    assert rounded[1] == 1234 and rounded[5] == 2
    floats = col(C.cast_column(money, "raw", "float"), "raw")
    assert floats[5] == 1.5 and floats[1] is None and floats[3] == 7.0
    rep = C.cast_report(money, "raw", "float").first()
    assert (rep["rows"], rep["failed"]) == (7, 4)  # $1,234.50  12%  abc  $1,000


def test_bool_words(flags):
    got = col(C.cast_column(flags, "yn", "bool"), "yn")
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: None}


def test_dates_auto_and_day_diff(dates):
    got = col(C.cast_column(dates, "raw", "date"), "raw")
    assert got[1] == dt.datetime(2024, 3, 1) and got[2] == dt.datetime(2024, 3, 15)
    assert got[3] is None and got[4] == dt.datetime(2024, 3, 1, 8, 30)
    days = col(X.day_difference(dates, "a", "b"), "days")
    assert days[1] == -1 and days[2] == 1 and days[3] is None and days[5] == 0


def test_replacement_is_literal(regex_frame):
    out = col(C.find_replace(regex_frame, "a.b", "$1\\x", ["t"], mode="contains"), "t")
    assert out[1] == "$1\\x" and out[3] == "$1\\x" and out[6] == "axb"
    rx = col(C.find_replace(regex_frame, r"a(.)b", "<$1>", ["t"], mode="regex", case=True), "t")
    assert rx[1] == "<.>" and rx[6] == "<x>" and rx[3] == "A.B"
    ex = col(C.find_replace(regex_frame, "A.B", "hit", ["t"], mode="exact"), "t")
    assert ex[1] == "hit" and ex[3] == "hit" and ex[6] == "axb"


def test_replace_first_only(regex_frame):
    out = col(C.replace_first(regex_frame, "b", "B", "t", ["k"]), "t")
    assert out[1] == "a.B" and out[3] == "A.B" and out[6] == "axb"


def test_dedupe_keeps_first(lookup):
    out = C.dedupe(lookup, ["key"], order_by=["ord"])
    got = {r["key"]: r["val"] for r in out.collect()}
    assert got == {"a": 2, "b": 3, "c": 4, None: 5}


def test_fill_stats(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, None, None), (3, 3.0, "y"), (4, 3.0, "y"), (5, 1.0, "x")],
                               "k long, v double, s string")
    assert col(C.fill_stat(df, ["v"], "mean"), "v")[2] == 2.0
    assert col(C.fill_stat(df, ["v"], "median"), "v")[2] == 2.0
    assert col(C.fill_stat(df, ["s"], "mode"), "s")[2] == "x"  # tie x/y -> smallest
    with pytest.raises(ValueError):
        C.fill_stat(df, ["s"], "mean")


@pytest.mark.parametrize("strategy", ["window", "positions"])
def test_forward_fill(spark, strategy):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", None), (4, "a", None), (5, "b", 2.0),
                                (6, "b", None)], "k long, g string, v double")
    got = col(C.forward_fill(df, ["v"], ["k"], ["g"], strategy=strategy), "v")
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: 1.0, 5: 2.0, 6: 2.0}
    glob = col(C.forward_fill(df, ["v"], ["k"], strategy=strategy), "v")
    assert glob == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0, 6: 2.0}


def test_blank_to_null_only_empty(nulls):
    got = col(C.blank_to_null(nulls, ["t"]), "t")
    assert got[3] is None and got[4] == "  "


def test_update_cells_and_edits(ties, spark):
    assert col(C.update_cells(ties, "k", 4, "v", 99), "v")[4] == 99
    edits = spark.createDataFrame([(1, 111), (2, None)], "k long, v long")
    got = col(C.apply_edits(ties, edits, "k"), "v")
    assert got[1] == 111 and got[2] == 20 and got[3] == 20


def test_map_values_and_if(ties):
    m = col(X.map_values(ties, "g", {"x": "ex"}, default="other", name="m"), "m")
    assert m[1] == "ex" and m[5] == "other" and m[8] == "other"
    t = col(X.if_then_else(ties, "big", "v > 15", "big", "`g`"), "big")
    assert t[2] == "big" and t[1] == "x" and t[7] == "y"


def test_text_steps(spark):
    df = spark.createDataFrame([(1, "  hello world \t"), (2, None)], "k long, s string")
    got = col(X.transform_column(df, "s", ["strip", "upper"]), "s")
    assert got == {1: "HELLO WORLD", 2: None}
    ext = col(X.transform_column(df, "s", [("extract", r"(w\w+)")]), "s")
    assert ext == {1: "world", 2: None}


def test_title_case_like_python(spark):
    df = spark.createDataFrame([(1, "o'neil mc-donald"), (2, "3rd STREET"), (3, ""), (4, None)], "k long, s string")
    got = col(X.transform_column(df, "s", ["title"]), "s")
    assert got == {1: "O'Neil Mc-Donald", 2: "3Rd Street", 3: "", 4: None}
    assert got[1] == "o'neil mc-donald".title() and got[2] == "3rd STREET".title()
