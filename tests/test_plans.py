"""Plan checks over every registered query (plans only, at sf0.001)."""

import __spark_entry__ as E
from gridspark.registry import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
SIDE_EFFECTS = ("stream_", "csv_roundtrip", "parquet_roundtrip", "export_")


def test_no_python_or_pairwise_operators(spark):
    bad = {}
    for key, fn in QUERIES.items():
        if key.startswith(SIDE_EFFECTS):
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in FORBIDDEN if w in plan]
        if hits:
            bad[key] = hits
    assert not bad, bad


def test_scans_are_pruned(spark):
    plan = E.queries()["agg_sum_by"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    plan = E.queries()["filter_cmp"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25.0)" in plan


def test_plans_of_reports(spark):
    def counts(key, *words):
        plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[-1]
        return [plan.count(w) for w in words]
    assert counts("null_report", "FileScan") == [1]
    assert counts("distinct_counts", "Expand ") == [0] and counts("text_issues", "Expand ") == [0]
    assert counts("corr_matrix", "FileScan") == [1]
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    from gridspark.operators.aggregate import corr_matrix
    plan = corr_matrix(li, ["l_quantity", "l_discount", "l_tax"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("covar_samp(") == 3


def test_a_deep_page_reads_only_its_slices(spark):
    spark.conf.set("gridspark.singleTaskRows", "100")
    try:
        plan = E.queries()["page_deep"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("gridspark.singleTaskRows")
    import re
    assert re.search(r"PushedFilters: \[[^\]]*(GreaterThanOrEqual|LessThanOrEqual)\(o_totalprice", plan)
    assert all(int(x) <= 300 for x in re.findall(r"limit=(\d+)", plan)) and "buckets" not in plan
