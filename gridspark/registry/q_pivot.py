"""Pivot and crosstab queries (V-P1 to V-P5)."""

from pyspark.sql import functions as F

from gridspark.operators.pivot import crosstab, pivot_long, pivot_map, pivot_table
from gridspark.registry.base import query, table


@query("pivot_sum", """
SELECT l_returnflag,
       round(coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0), 2) AS "F",
       round(coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0), 2) AS "O"
FROM lineitem GROUP BY 1""")
def pivot_sum(spark, d):
    out = pivot_table(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "sum")
    return out.select("l_returnflag", *[F.round(c, 2).alias(c) for c in ("F", "O")])


_STAT = ["F", "O", "P"]
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("pivot_mean", "SELECT o_orderpriority, " + ", ".join(
    f"round(coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 0), 4) AS \"{s}\""
    for s in _STAT) + " FROM orders GROUP BY 1")
def pivot_mean(spark, d):
    out = pivot_table(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "mean")
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in _STAT])


@query("pivot_nunique", "SELECT c_nationkey, " + ", ".join(
    f"count(DISTINCT c_acctbal) FILTER (WHERE c_mktsegment = '{s}') AS \"{s}\""
    for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    + " FROM customer GROUP BY 1")
def pivot_nunique(spark, d):
    return pivot_table(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", "nunique")


_COMBOS = [f"{r}_{s}" for r in ("A", "N", "R") for s in ("F", "O")]


@query("pivot_multi_cols", "SELECT l_linenumber, " + ", ".join(
    f"count(l_orderkey) FILTER (WHERE l_returnflag || '_' || l_linestatus = '{k}') AS \"{k}\""
    for k in _COMBOS) + " FROM lineitem GROUP BY 1")
def pivot_multi_cols(spark, d):
    return pivot_table(table(spark, d, "lineitem"), "l_linenumber", ["l_returnflag", "l_linestatus"],
                       "l_orderkey", "count")


@query("pivot_no_columns", """
SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1""")
def pivot_no_columns(spark, d):
    out = pivot_table(table(spark, d, "orders"), "o_orderstatus", None, "o_totalprice", "sum")
    return out.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("crosstab", "SELECT o_orderpriority, " + ", ".join(
    f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in _STAT)
    + " FROM orders GROUP BY 1")
def crosstab_q(spark, d):
    return crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("crosstab_totals", "SELECT o_orderpriority, " + ", ".join(
    f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in _STAT)
    + ", count(*) AS \"Total\" FROM orders GROUP BY 1 UNION ALL SELECT 'Total', " + ", ".join(
    f"count(*) FILTER (WHERE o_orderstatus = '{s}')" for s in _STAT) + ", count(*) FROM orders")
def crosstab_totals(spark, d):
    return crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", totals=True)


@query("labels_crosstab", """
SELECT CAST(quality AS VARCHAR) AS quality, count(*) FILTER (WHERE toxic = 0) AS "0",
       count(*) FILTER (WHERE toxic = 1) AS "1", count(*) AS "Total" FROM labels GROUP BY 1
UNION ALL SELECT 'Total', count(*) FILTER (WHERE toxic = 0), count(*) FILTER (WHERE toxic = 1), count(*)
FROM labels""")
def labels_crosstab(spark, d):
    return crosstab(table(spark, d, "labels"), "quality", "toxic", totals=True)


# two text keys whose values, joined with "_", come out equal for different pairs
_KEY_A = "CASE WHEN o_orderstatus = 'P' THEN 'a_b' ELSE 'a' END"
_KEY_B = "CASE WHEN o_orderstatus = 'F' THEN 'c' ELSE 'b_c' END"


@query("pivot_colliding_keys", "SELECT o_orderpriority, " + ", ".join(
    f"count(*) FILTER (WHERE {_KEY_A} = '{a}' AND {_KEY_B} = '{b}') AS \"{a}/{b}\""
    for a, b in (("a", "b_c"), ("a", "c"), ("a_b", "b_c"), ("a_b", "c"))) + " FROM orders GROUP BY 1")
def pivot_colliding_keys(spark, d):
    o = table(spark, d, "orders").withColumn("ka", F.expr(_KEY_A)).withColumn("kb", F.expr(_KEY_B))
    return pivot_table(o, "o_orderpriority", ["ka", "kb"], "o_orderkey", "count", sep="/",
                       values=[("a", "b_c"), ("a", "c"), ("a_b", "b_c"), ("a_b", "c")])


_RATES = [i / 100000 for i in range(0, 11)]


@query("pivot_double", "SELECT l_returnflag, " + ", ".join(
    f"count(*) FILTER (WHERE round(l_discount * 100) = {i}) AS \"{r}\"" for i, r in enumerate(_RATES))
    + " FROM lineitem GROUP BY 1")
def pivot_double(spark, d):
    li = table(spark, d, "lineitem").withColumn("rate", F.round(F.col("l_discount") * 100) / 100000)
    return crosstab(li, "l_returnflag", "rate", values=_RATES)


@query("pivot_long_orders", """
SELECT o_custkey, o_orderkey, sum(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY 1, 2""")
def pivot_long_orders(spark, d):
    return pivot_long(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


# a column key for each order: the map's entries, written out
@query("pivot_map_orders", """
WITH c AS (SELECT l_suppkey, CAST(l_orderkey AS VARCHAR) || '/' || l_linestatus AS k, count(l_quantity) AS n
           FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, string_agg(k || '=' || n, ',' ORDER BY k) AS cells, count(*) AS keys FROM c GROUP BY 1""")
def pivot_map_orders(spark, d):
    out = pivot_map(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linestatus"], "l_quantity", "count", sep="/")
    entry = F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("l_suppkey", F.array_join(entry, ",").alias("cells"), F.size("cells").cast("long").alias("keys"))


@query("pivot_text_max", """
SELECT o_orderpriority, max(CAST(o_orderdate AS VARCHAR)) FILTER (WHERE o_orderstatus = 'F') AS "F",
       max(CAST(o_orderdate AS VARCHAR)) FILTER (WHERE o_orderstatus = 'O') AS "O" FROM orders
WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def pivot_text_max(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").withColumn("day", F.col("o_orderdate").cast("string"))
    return pivot_table(o, "o_orderpriority", "o_orderstatus", "day", "max", values=["F", "O"])
