"""Columns named like the operators' own, all-null columns, awkward fills and edits."""

import pytest
from pyspark.sql import functions as F

from gridspark.operators.aggregate import aggregate, column_stats, describe
from gridspark.operators.clean import apply_edits, forward_fill
from gridspark.operators.issues import apply_fix
from gridspark.operators.join import concat_columns
from gridspark.operators.pivot import pivot_table
from gridspark.operators.rank import category_codes, rank, ranks, top_n_ranked

OWN = ["_alone", "_uid", "_n", "_b", "_before", "_dense", "_total", "_ndist", "__r", "_r", "_s", "q", "value", "_h", "c0"]


@pytest.fixture(scope="module")
def own(spark):
    rows = [(i % 3, i // 2 if i % 5 else None, *[100 * j + i for j in range(len(OWN))]) for i in range(30)]
    return spark.createDataFrame(rows, "g long, v long, " + ", ".join(f"`{n}` long" for n in OWN))


def kept(df, out):
    """The user's columns as they went in."""
    cols = [f"`{c}`" for c in df.columns]
    return sorted(map(tuple, out.select(*cols).fillna(-1).collect())) == sorted(map(tuple, df.fillna(-1).select(*cols).collect()))


@pytest.mark.parametrize("strategy", ["window", "positions"])
@pytest.mark.parametrize("group", ["g", "_n", "value"])
def test_ranks_and_fills_keep_clashing_columns(own, strategy, group):
    for method in ("min", "average", "first", "percentile"):
        out = rank(own, "v", method, group=group, strategy=strategy, tiebreak=["_uid"])
        assert out.columns == [*own.columns, "v_rank"] and kept(own, out)
    assert kept(own, ranks(own, "v", {"a": "min", "b": "dense"}, group=group, strategy=strategy))
    filled = forward_fill(own, ["v"], ["_uid"], [group], strategy=strategy)
    assert kept(own.drop("v"), filled.drop("v"))
    one = forward_fill(own, ["v"], ["_uid"], strategy=strategy).orderBy("_uid")
    assert [r.v for r in one.collect()][:3] == [None, 0, 1]
    med = aggregate(own, [group], [("v", "median", "_n_med")], strategy=strategy)
    assert med.columns == [group, "_n_med"] and med.count() == own.select(f"`{group}`").distinct().count()


def test_other_operators_keep_clashing_columns(own):
    for method in ("min", "first"):
        out = top_n_ranked(own, "v", 1000, method, tiebreak=["_uid"])
        assert kept(own.where("v is not null"), out)
    out = category_codes(own, "v")
    assert out.columns == [*own.columns, "v_code"] and kept(own, out)
    pair = concat_columns(own, own.select("_uid", F.col("v").alias("__pos")), ["_uid"], [("_uid", True)])
    assert pair.where("`_uid_L` <> `_uid_R`").count() == 0 and pair.count() == 30


@pytest.mark.parametrize("strategy", ["window", "positions"])
def test_all_null_nan_constant_and_empty_columns(spark, strategy):
    df = spark.createDataFrame([(None, float("nan"), 2.0, 1), (None, 1.0, 2.0, None), (None, None, 2.0, 3)],
                               "none double, nan double, same double, i int")
    for frame, n in ((df, 3), (df.limit(0), 0)):
        got = {r["column"]: r.asDict() for r in describe(frame, strategy=strategy).collect()}
        for c in ("none", *([] if n else df.columns)):
            row = got.get(c, {})
            assert all(row.get(s) is None for s in ("mean", "std", "min", "p25", "p50", "p75", "max"))
            assert row.get("count", 0) == 0
        if n:
            assert (got["same"]["p25"], got["same"]["std"], got["i"]["p50"]) == (2.0, 0.0, 2.0)


def test_column_stats_of_an_all_null_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    got = {r["column"]: r for r in column_stats(df).collect()}
    assert got["a"]["count"] == 0 and got["a"]["p50"] is None and got["b"]["p50"] == 1.5


def test_text_pivot_keeps_null_under_a_numeric_fill(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "k long, p string, t string")
    got = [tuple(r) for r in pivot_table(df, "k", "p", "t", "max").collect()]
    assert got == [(1, "x", "y"), (2, "z", None)]
    assert [tuple(r) for r in pivot_table(df, "k", "p", "t", "max", fill="-").collect()][1] == (2, "z", "-")


def test_edits_change_cells_once(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7), (2, "d", 8)], "k long, t string, _e0 long")
    edits = spark.createDataFrame([(2, "B"), (9, "Z"), (None, "N")], "k long, t string")
    assert sorted(map(tuple, apply_edits(df, edits, "k").fillna(0).collect())) == [
        (0, "c", 7), (1, "a", 5), (2, "B", 6), (2, "B", 8)]
    with pytest.raises(Exception, match="several edits"):
        apply_edits(df, edits.union(edits), "k").collect()
    with pytest.raises(ValueError):
        apply_edits(df, edits.withColumnRenamed("t", "u"), "k")


def test_large_float_ids_become_null(spark):
    df = spark.createDataFrame([(12.0,), (1e19,)], "x double")
    assert [r.x for r in apply_fix(df, "x", "float_id_precision").collect()] == [12, None]
