"""Pages through an order index against a plain sort."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridspark.operators.project import page
from gridspark.plans import ordered
from gridspark.plans.order_index import OrderIndex


def every(index, size):
    n = -(-index.rows // size)
    return [tuple(r) for i in range(1, n + 1) for r in index.page(i, size).collect()]


@pytest.mark.parametrize("order", [["a", "k"], [("a", False), ("s", True), "k"], [("s", False), ("a", False), ("k", False)]])
def test_pages_follow_the_order(spark, order):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, float("nan"), -0.5, 1.0, rnd.random()]),
             rnd.choice([None, "", "a'b", "ä", "z" * rnd.randint(0, 3)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, s string").repartition(3)
    want = [tuple(r) for r in df.orderBy(*ordered.sort_order(order)).collect()]
    got = every(OrderIndex(df, order, slices=5, most=30), 45)
    assert [r[0] for r in got] == [r[0] for r in want]


def test_hot_and_equal_rows_are_neither_lost_nor_doubled(spark):
    rows = [(1, "x", i % 50) for i in range(300)] + [(1, "x", 7)] * 200 + [(0, "a", 0), (2, "b", 1), (None, "c", 2)]
    df = spark.createDataFrame(rows, "v long, s string, _hash long").repartition(4)
    index = OrderIndex(df, ["v"], slices=4, most=20)
    got = every(index, 60)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(rows, key=key)
    assert got[0] == (0, "a", 0) and got[-1] == (None, "c", 2)
    first = [tuple(r) for r in page(df, 1, 60, ["v"]).collect()]
    assert first == got[:60]


def test_types_of_keys(spark):
    t = dt.datetime(2024, 3, 31, 1, 30)
    rows = [(i, t + dt.timedelta(minutes=17 * i), dt.date(2024, 1, 1) + dt.timedelta(days=i % 9), Decimal(i) / 7, i % 2 == 0,
             bytes([i % 5, 255]), float(i) / 3) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, n timestamp_ntz, d date, m decimal(20,9), b boolean, y binary, f float")
    df = df.withColumn("z", F.col("n").cast("timestamp"))
    for c in df.columns[1:]:
        got = every(OrderIndex(df.select("k", c), [(c, False), "k"], slices=4, most=9), 50)
        want = [r[0] for r in df.orderBy(F.col(c).desc(), "k").select("k").collect()]
        assert [r[0] for r in got] == want, c


def test_nothing_is_written_and_the_scan_is_pruned(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).select("id", (F.col("id") * 3).alias("v"), F.lit("x" * 50).alias("wide")).repartitionByRange(
        4, "v").write.parquet(path)
    monkeypatch.setattr(ordered, "scratch_path", lambda *a: pytest.fail("wrote a table"))
    index = OrderIndex(spark.read.parquet(path), [("v", False)], most=500)
    out = index.page(30, 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "OrEqual(v," in plan
    assert [r.id for r in out.collect()] == list(range(20_000 - 2_900 - 1, 20_000 - 3_000 - 1, -1))
    cut = index._root.parts
    assert cut and max(p.rows for p in cut) < 2_000 and sum(p.rows for p in cut) == 20_000


def test_past_the_end_empty_and_bad_arguments(spark):
    df = spark.range(10)
    index = OrderIndex(df, ["id"])
    assert [r.id for r in index.page(9, 4).collect()] == [0, 1, 2, 3] and index.page(9, 4, False).count() == 0
    assert OrderIndex(df.limit(0), ["id"]).page(1, 5).count() == 0
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            index.page(*bad)
    with pytest.raises(ValueError):
        OrderIndex(df, [])
