import os
import uuid

import pytest
from pyspark.sql import functions as F

from gridspark.functions.columns import col_letter, parse_col_letter, parse_column_list, resolve_column
from gridspark.operators.project import clean_names, page, sample_rows, tail
from gridspark.plans.sql import run_sql
from gridspark.plans.views import apply_view, validate_view, view_from_json, view_to_json
from gridspark.session import checkpoint_dir
from gridspark.sources import io as S


def test_column_letters():
    assert [col_letter(i) for i in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]
    assert parse_col_letter("aa") == 26 and parse_col_letter("A") == 0


def test_resolve_precedence():
    cols = ["name", "age", "city", "first_name"]
    assert resolve_column("NAME", cols) == "name"
    assert resolve_column(2, cols) == "age"
    assert resolve_column("3", cols) == "city"
    assert resolve_column("B", cols) == "age"
    assert resolve_column("first", cols) == "first_name"
    with pytest.raises(KeyError):
        resolve_column("nme", ["name", "first_name"])  # substring ambiguous / unknown
    assert parse_column_list("1-2, D, 1", cols) == ["name", "age", "first_name"]
    assert parse_column_list("all", cols) == cols


def test_clean_names_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` long, `a  B` long")
    with pytest.raises(ValueError):
        clean_names(df)


def test_page_and_tail(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    assert [r["k"] for r in page(df, 2, 3, ["k"]).collect()] == [3, 4, 5]
    assert sorted(r["k"] for r in page(df, 9, 3, ["k"]).collect()) == [0, 1, 2]  # past the end: page 1
    assert [r["k"] for r in tail(df, 2, ["k"]).collect()] == [8, 9]


def test_sample_is_deterministic(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a = sorted(r["k"] for r in sample_rows(df, 20, ["k"]).collect())
    b = sorted(r["k"] for r in sample_rows(df.repartition(7), 20, ["k"]).collect())
    assert a == b and len(a) == 20


def test_view_roundtrip_and_apply(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "k long, g long")
    spec = {"filters": [{"column": "g", "op": "==", "value": 1}, {"column": "gone", "op": "==", "value": 1}],
            "sort": [{"column": "k", "ascending": False}], "columns": ["k"], "page": 1, "page_size": 3}
    assert validate_view(spec, df.columns) == ["filter column 'gone' not in table"]
    out = apply_view(df, view_from_json(view_to_json(spec)))
    assert [r["k"] for r in out.collect()] == [19, 16, 13]


def test_sql_guard(spark):
    df = spark.range(3)
    assert run_sql(spark, "SELECT count(*) AS n FROM df", current=df).first()["n"] == 3
    with pytest.raises(ValueError):
        run_sql(spark, "DROP TABLE df")
    with pytest.raises(ValueError):
        run_sql(spark, "SELECT 1; DROP TABLE df")


def _scratch(spark):
    return os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")


def test_csv_semicolon_sniff_and_modes(spark):
    path = _scratch(spark)
    df = spark.createDataFrame([("Ann", 30, "NYC")], "name string, age int, city string")
    S.write_csv(df, path, sep=";")
    back = S.read_csv(spark, path)
    assert back.columns == ["name", "age", "city"] and back.first()["age"] == 30
    with pytest.raises(Exception):
        S.write_csv(df, path, mode="fail")
    S.write_csv(df, path, mode="append", sep=";")
    assert S.read_csv(spark, path).count() == 2
    with pytest.raises(ValueError):
        S.write_csv(df, path, mode="sometimes")


def test_create_table_types(spark):
    t = S.create_table(spark, [("a", "str"), ("b", "int"), ("c", "date")], n_rows=3)
    assert t.count() == 3 and dict(t.dtypes) == {"a": "string", "b": "bigint", "c": "timestamp_ntz"}
    assert S.create_table(spark, [("x", "float")]).count() == 0


def test_schema_listing(spark):
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    assert [r["column"] for r in S.table_schema(df).collect()] == ["k", "s"]
