import random

import numpy as np
import pytest

from gridspark.operators import aggregate as A
from gridspark.operators.heavy import candidates, top_values_bounded
from gridspark.operators.wide import corr_pairs


def brute(values, k):
    count = {}
    for v in values:
        if v is not None:
            count[v] = count.get(v, 0) + 1
    return sorted(count.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("k", [1, 7, 40])
def test_top_values_equal_a_full_count(spark, k):
    rnd = random.Random(k)
    values = ([rnd.randrange(40_000) for _ in range(30_000)] + [5] * 9000 + [None] * 500
              + [int(rnd.paretovariate(0.8)) for _ in range(5000)])
    rnd.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "`_v` long").repartition(5)
    got = top_values_bounded(df, "_v", k, buckets=4096).collect()
    assert [(r["value"], r["count"]) for r in got] == brute(values, k)
    assert [r["rank"] for r in got] == list(range(1, k + 1))


def test_only_few_buckets_are_counted_on_a_near_unique_column(spark):
    values = list(range(20_000)) + [x for x in range(50) for _ in range(20 + x)]
    df = spark.createDataFrame([(v,) for v in values], "_v long")
    kept, bound = candidates(df, 10, 1 << 14)
    assert len(kept) <= 60 and bound.sum() == len(values)
    assert bound[kept].sum() < 0.2 * len(values)


def test_ties_beyond_the_first_look_are_not_missed(spark):
    values = [x for x in range(3000) for _ in range(2)]
    df = spark.createDataFrame([(f"t{v:05d}",) for v in values], "t string")
    got = top_values_bounded(df, "t", 5, buckets=256).collect()
    assert [r["value"] for r in got] == [f"t{i:05d}" for i in range(5)] and {r["count"] for r in got} == {2}


def test_top_values_of_doubles_empty_and_few(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (float("nan"),), (None,)], "v double")
    got = [(str(abs(r["value"])), r["count"]) for r in top_values_bounded(df, "v").collect()]
    assert got == [("nan", 3), ("0.0", 2)]
    assert top_values_bounded(df.limit(0), "v").collect() == []
    with pytest.raises(ValueError):
        top_values_bounded(df, "v", buckets=100)


def sparse(seed, rows, columns):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, columns)) @ rng.normal(size=(columns, columns)) + rng.normal(size=columns) * 1e4
    return x, rng.random((rows, columns)) < 0.85


@pytest.mark.parametrize("block", [3, 4, 256])
def test_corr_pairs_equal_numpy_over_complete_rows(spark, block):
    x, here = sparse(1, 300, 10)
    df = spark.createDataFrame([[float(v) if h else None for v, h in zip(r, m)] for r, m in zip(x, here)],
                               ", ".join(f"`x.{i}` double" for i in range(10))).repartition(3)
    got = {(r["a"], r["b"]): r for r in corr_pairs(df, block=block).collect()}
    assert len(got) == 55
    for i in range(10):
        for j in range(i, 10):
            both = here[:, i] & here[:, j]
            r = got[(f"x.{i}", f"x.{j}")]
            assert r["n"] == both.sum()
            assert r["corr"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_corr_pairs_constant_null_and_non_finite(spark):
    rows = [(1.0, 0.1, None, 1.0, 5), (2.0, 0.1, None, float("nan"), 4), (4.0, 0.1, None, 2.0, 9), (None, 0.1, None, 3.0, 1)]
    df = spark.createDataFrame(rows, "i double, flat double, none double, odd double, n int")
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in corr_pairs(df).collect()}
    assert got[("i", "i")] == (3, 1.0) and got[("flat", "flat")] == (4, None) and got[("i", "flat")] == (3, None)
    assert got[("none", "none")] == (0, None) and got[("i", "none")] == (0, None)
    assert np.isnan(got[("i", "odd")][1]) and got[("i", "odd")][0] == 3
    want = A.corr_matrix(df.select("i", "n")).where("column = 'i'").first()["n"]
    assert got[("i", "n")][1] == pytest.approx(want, abs=1e-12)
    assert {r["n"] for r in corr_pairs(df.limit(0)).collect()} == {0}


def test_five_hundred_columns(spark):
    x, _ = sparse(2, 40, 500)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(500)))
    got = corr_pairs(df)
    assert got.count() == 500 * 501 // 2
    r = got.where("a = 'c3' and b = 'c499'").first()
    assert r["corr"] == pytest.approx(np.corrcoef(x[:, 3], x[:, 499])[0, 1], abs=1e-9)
