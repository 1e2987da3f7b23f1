"""Projection, slicing, sorting and set queries."""

from pyspark.sql import functions as F

from gridspark.operators.order import distinct, limit, sort, top_n, union_all
from gridspark.operators.project import (add_constant, clean_names, column_window, drop_columns,
                                         head, page, rename_column, sample_rows, select_columns,
                                         tail)
from gridspark.operators.join import stack
from gridspark.plans.order_index import OrderIndex
from gridspark.registry.base import query, table


@query("project_refs", "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def project_refs(spark, d):
    # exact name, 1-based number, spreadsheet letter, unique name part
    return select_columns(table(spark, d, "customer"), ["c_name", 3, "D", "segment"])


@query("project_ranges", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def project_ranges(spark, d):
    return select_columns(table(spark, d, "customer"), "1-3, E, 2")


@query("column_window", "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders")
def column_window_q(spark, d):
    return column_window(table(spark, d, "orders"), 1, 3)


@query("rename_drop", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total, o_orderdate FROM orders""")
def rename_drop(spark, d):
    o = table(spark, d, "orders")
    return drop_columns(rename_column(o, "o_totalprice", "total"), ["o_orderpriority"])


@query("clean_names", """
SELECT c_custkey AS cust_key, c_name AS cust_name, c_nationkey AS nation_key, c_acctbal AS account_balance,
       c_mktsegment AS market_segment FROM customer""")
def clean_names_q(spark, d):
    c = table(spark, d, "customer").toDF(" Cust Key", "Cust  Name ", "NATION KEY", "Account\tBalance",
                                         "Market Segment")
    return clean_names(c)


@query("add_constant", "SELECT *, 'tpch' AS source FROM customer")
def add_constant_q(spark, d):
    return add_constant(table(spark, d, "customer"), "source", "tpch")


@query("head", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def head_q(spark, d):
    return head(table(spark, d, "orders"), 100, order_by=["o_orderdate", "o_orderkey"])


@query("tail", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def tail_q(spark, d):
    return tail(table(spark, d, "orders"), 50, order_by=["o_totalprice", "o_orderkey"])


@query("page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def page_q(spark, d):
    return page(table(spark, d, "orders"), 3, 100, order_by=["o_orderkey"])


# page 400 of 50 rows: past the end of supplier at small scale (then page 1 comes back),
# an ordinary page once supplier has more than 19 950 rows
@query("page_past_end", """
(SELECT * FROM supplier ORDER BY s_suppkey LIMIT 50 OFFSET 19950)
UNION ALL
(SELECT * FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 50)
 WHERE (SELECT count(*) FROM supplier) <= 19950)""")
def page_past_end_q(spark, d):
    return page(table(spark, d, "supplier"), 400, 50, order_by=["s_suppkey"])


# deep in the table at any scale: the page that holds the row after two thirds of the orders
@query("page_deep", """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey
LIMIT 100 OFFSET (SELECT CAST(count(*) AS BIGINT) * 2 // 300 * 100 FROM orders)""")
def page_deep_q(spark, d):
    o = table(spark, d, "orders")
    number = o.count() * 2 // 300 + 1
    return page(o, number, 100, order_by=[("o_totalprice", False), "o_orderkey"])


# three pages of one index, its slices cut small enough to need several of them
@query("page_index", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_custkey, o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_custkey, o_orderpriority, CAST((r - 1) // 40 + 1 AS INTEGER) AS page FROM o
WHERE (r - 1) // 40 + 1 IN (1, 7, (SELECT count(*) FROM orders) // 80)""")
def page_index_q(spark, d):
    o = table(spark, d, "orders")
    index = OrderIndex(o, [("o_orderpriority", False), "o_custkey", "o_orderkey"], most=1000)
    pages = [index.page(n, 40).select("o_orderkey", "o_custkey", "o_orderpriority", F.lit(n).alias("page"))
             for n in sorted({1, 7, index.rows // 80})]
    return stack(*pages)


@query("limit_after_sort", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def limit_after_sort(spark, d):
    return limit(sort(table(spark, d, "customer"), ["c_acctbal", "c_custkey"], [False, True]), 25)


@query("project_fuzzy", "SELECT o_orderpriority, o_totalprice, o_custkey FROM orders")
def project_fuzzy(spark, d):
    return select_columns(table(spark, d, "orders"), ["o_ordrpriorty", "totalprce", "o_custkey"], fuzzy=0.7)


@query("sample_hash", """
SELECT * FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200""")
def sample_hash_q(spark, d):
    return sample_rows(table(spark, d, "orders"), 200, key=["o_orderkey"], seed=42)


@query("sort_nulls_last", """
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS prio
FROM orders ORDER BY prio DESC NULLS LAST, o_orderkey""")
def sort_nulls_last(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice",
        F.expr("CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END").alias("prio"))
    return sort(o, [("prio", False), ("o_orderkey", True)])


@query("topn", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topn_q(spark, d):
    return top_n(table(spark, d, "orders"), "o_totalprice", 20, tiebreak=["o_orderkey"])


@query("union_all", """
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS acctbal, NULL::VARCHAR AS segment FROM supplier
UNION ALL
SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer""")
def union_all_q(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS acctbal")
    c = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name",
                                               "c_acctbal AS acctbal", "c_mktsegment AS segment")
    return union_all(s, c)


@query("distinct_values", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_q(spark, d):
    return distinct(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
