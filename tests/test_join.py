import pytest
from pyspark.sql import functions as F


from gridspark.operators.join import (concat_columns, join, lookup_column, natural_join, stack,
                                      vlookup_join)


def test_lookup_first_never_multiplies(spark, lookup):
    left = spark.createDataFrame([("a",), ("b",), ("z",), (None,), ("a",)], "key string")
    out = lookup_column(left, lookup, "key", "key", "val", "first", order_by=["ord"])
    assert out.count() == 5
    got = sorted((r["key"] or "", r["val"]) for r in out.collect())
    assert got == [("", None), ("a", 2), ("a", 2), ("b", 3), ("z", None)]
    s = lookup_column(left, lookup, "key", "key", "val", "sum")
    assert {r["key"]: r["val"] for r in s.collect()}["a"] == 3


def test_join_suffixes_and_keys(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "id long, name string, v long")
    b = spark.createDataFrame([(1, "p", 5), (3, "q", 6)], "id long, name string, w long")
    out = join(a, b, "id", how="full")
    assert set(out.columns) == {"id", "name_L", "v", "name_R", "w"}
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]
    nat = natural_join(a.select("id", "v"), b.select("id", "w"))
    assert nat.count() == 2


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "key string, v long")
    b = spark.createDataFrame([(None, 10)], "key string, w long")
    assert join(a, b, "key", how="inner").count() == 0
    assert join(a, b, "key", how="inner", null_safe=True).count() == 1


def test_vlookup_single_key_column(spark):
    a = spark.createDataFrame([(1, "x")], "cust long, s string")
    b = spark.createDataFrame([(1, "Ann")], "id long, name string")
    out = vlookup_join(a, b, "cust", "id")
    assert out.columns == ["cust", "s", "name"]


def test_stack_with_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 3.0)], "id long, b double")
    out = stack(a, b)
    assert out.count() == 2 and set(out.columns) == {"id", "a", "b"}


def test_concat_by_position_pads(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "o long, x string")
    b = spark.createDataFrame([(10, "p"), (20, "q")], "o long, y string")
    out = concat_columns(a, b, ["o"], ["o"])
    got = sorted((r["row_position"], r["x"], r["y"]) for r in out.collect())
    assert got == [(1, "a", "p"), (2, "b", "q"), (3, "c", None)]


def test_cross_join_refused(spark):
    import pytest
    a = spark.range(2)
    with pytest.raises(ValueError):
        join(a, a, "id", how="cross")


def test_joins_carry_no_broadcast_hint(spark):
    from gridspark.operators.derive import map_values_table
    a = spark.range(5).withColumnRenamed("id", "k")
    m = spark.createDataFrame([("1", "one")], "key string, val string")
    for df in (join(a, a.withColumn("v", F.col("k")), "k"), map_values_table(a, "k", m, "key", "val")):
        assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_null_order_keys_come_last(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3)], "k string, o long, v long")
    got = lookup_column(left, right, "k", "k", "v", "first", order_by=["o"])
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 3)]
    x = spark.createDataFrame([(1,), (None,)], "x long")
    y = spark.createDataFrame([(5,), (6,)], "y long")
    assert sorted(map(tuple, concat_columns(x, y, ["x"], ["y"]).collect()), key=lambda r: r[2]) == [(1, 5, 1), (None, 6, 2)]


def test_mapping_key_given_twice(spark):
    from gridspark.operators.derive import map_values_table
    a = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    same = spark.createDataFrame([("1", "one"), (" 1", "one"), (None, "x")], "key string, val string")
    assert sorted(map(tuple, map_values_table(a, "k", same, "key", "val").collect()), key=repr) == [("2",), ("one",), (None,)]
    with pytest.raises(Exception, match="given twice"):
        map_values_table(a, "k", same.unionAll(spark.createDataFrame([("1", "uno")], same.schema)), "key", "val").collect()
