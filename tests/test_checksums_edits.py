"""Diff by checksums, pivots without a fixed schema, edits written back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators.checksums import checksums, diff_by_checksum, differing_buckets, rows_in_buckets
from gridspark.operators.diff import table_diff
from gridspark.operators.pivot import pivot_long, pivot_map, pivot_table
from gridspark.sources.edits import edit_table

SCHEMA = "k long, f double, s string, m map<string,int>, _bucket int"


def frames(spark, seed):
    rnd = random.Random(seed)
    old = {i: (rnd.choice([None, 0.0, -0.0, float("nan"), 1.5]), rnd.choice([None, "", "a"]), {"x": i, "y": 1}, i) for i in range(300)}
    new = {k: v for k, v in old.items() if rnd.random() > .02}
    for k in rnd.sample(sorted(new), 12):
        new[k] = (new[k][0], rnd.choice(["b", None, "a"]), new[k][2], rnd.choice([new[k][3], -1]))
    new.update({1000 + i: (1.0, "n", None, 0) for i in range(5)})
    new = {k: (0.0 if v[0] is not None and v[0] == 0 else v[0], v[1], v[2] and dict(reversed(v[2].items())), v[3]) for k, v in new.items()}
    rows = [[(k, *v) for k, v in t.items()] + [(None, 1.0, s, None, 1)] for t, s in ((old, "p"), (new, "q"))]
    return [spark.createDataFrame(r, SCHEMA).repartition(3) for r in rows]


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("bits", [1, 6, 16])
def test_same_as_the_full_diff(spark, bits):
    a, b = frames(spark, bits)
    cols = ["f", "s", "_bucket"]
    assert shown(diff_by_checksum(a, b, "k", cols, bits)) == shown(table_diff(a, b, "k", cols))
    stored = checksums(a, "k", cols, bits)
    assert shown(diff_by_checksum(a, b, "k", cols, bits, stored)) == shown(table_diff(a, b, "k", cols))
    assert diff_by_checksum(a, a.repartition(5), "k", cols, bits).count() == 0
    assert differing_buckets(checksums(a, "k", bits=bits), checksums(a.repartition(2), "k", bits=bits), bits).count() == 0


def test_only_differing_buckets_are_joined(spark):
    a = spark.range(50_000).select("id", (F.col("id") % 97).alias("v"))
    b = a.withColumn("v", F.when(F.col("id").isin(5, 40_000), -1).otherwise(F.col("v"))).where("id <> 7")
    found = differing_buckets(checksums(a, "id"), checksums(b, "id"))
    assert found.count() == 3
    assert rows_in_buckets(a, ["id"], found).count() < 30
    out = diff_by_checksum(a, b, "id")
    assert {(r.id, r.status) for r in out.collect()} == {(5, "changed"), (40_000, "changed"), (7, "removed")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[:plan.index("Join FullOuter")]
    assert "Join FullOuter" in plan and plan.count("Join LeftSemi") >= 2 and "Scan" not in join


def test_key_types_and_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    assert diff_by_checksum(a, a.dropDuplicates(), "k").count() == table_diff(a, a.dropDuplicates(), "k").count() == 0
    with pytest.raises(ValueError):
        diff_by_checksum(a, a.withColumn("k", F.col("k").cast("int")), "k")
    with pytest.raises(ValueError):
        checksums(a, "k", bits=30)
    assert diff_by_checksum(a.limit(0), a, "k").where("status = 'added'").count() == 3


def test_pivots_without_a_fixed_schema(spark):
    rows = [(1, "a", "x", 2), (1, "a", "y", 3), (1, "a", "x", 5), (2, "b", "x", None), (2, None, "z", 1), (None, "a", "x", 9)]
    df = spark.createDataFrame(rows, "r0 long, p string, q string, _cell int")
    assert sorted(map(tuple, pivot_long(df, "r0", ["p", "q"], "_cell").collect())) == [
        (1, "a", "x", 7), (1, "a", "y", 3), (2, "b", "x", 0)]
    got = {r.r0: r["cells"] for r in pivot_map(df, "r0", ["p", "q"], "_cell", sep="/").collect()}
    assert got == {1: {"a/x": 7, "a/y": 3}, 2: {"b/x": 0}}
    wide = {r["r0"]: r.asDict() for r in pivot_table(df, "r0", "q", "_cell", "max").collect()}
    most = {r.r0: r["cells"] for r in pivot_map(df, "r0", "q", "_cell", "max").collect()}
    assert all(wide[k][c] == v for k, m in most.items() for c, v in m.items() if v is not None)
    many = spark.range(30_000).select((F.col("id") % 3).alias("g"), "id", F.lit(1).alias("n"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = pivot_map(many, "g", "id", "n")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before     # nothing is read to plan it
    assert [r.n for r in out.select(F.size("cells").alias("n")).collect()] == [10_000] * 3
    assert pivot_map(df.limit(0), "r0", "p", "_cell").count() == 0


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("by", [["p"], ["p", "q"]])
def test_only_partitions_with_edits_are_rewritten(spark, tmp_path, by):
    path = str(tmp_path / "t")
    df = spark.range(200).select("id", (F.col("id") % 4).cast("int").alias("p"),
                                 F.when(F.col("id") % 8 < 4, "u v").alias("q"), F.lit("old").alias("t"))
    df.write.partitionBy(*by).parquet(path)
    before = files(path)
    edits = spark.createDataFrame([(5, "new"), (9, "new"), (13, None), (999, "none")], "id long, t string")
    n = edit_table(spark, path, edits, "id", by)
    after = files(path)
    assert n == len(by)
    kept = {f: t for f, t in before.items() if "p=1" not in f}
    assert kept and all(after.get(f) == t for f, t in kept.items()) and not set(before) - set(kept) & set(after)
    back = {r.id: (r.p, r.q, r.t) for r in spark.read.parquet(path).collect()}
    want = {r.id: (r.p, r.q, "new" if r.id in (5, 9) else "old") for r in df.collect()}
    assert back == want
    with pytest.raises(ValueError, match="several"):
        edit_table(spark, path, edits.union(edits), "id", by)
    with pytest.raises(ValueError):
        edit_table(spark, path, edits.select("id", F.lit(1).alias("p")), "id", by)
    assert edit_table(spark, path, edits.where("id = 999"), "id", by) == 0 and files(path) == after
