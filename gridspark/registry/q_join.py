"""Join, lookup and concatenation queries."""

from pyspark.sql import functions as F

from gridspark.operators.join import (concat_columns, join, lookup_column, natural_join, stack,
                                      vlookup_join)
from gridspark.registry.base import query, table


@query("join_left", "SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_left(spark, d):
    return join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", "left")


@query("join_inner", "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, d):
    return join(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey",
                "inner")


# whole tables on both sides; the expression leaves rows without a partner on either side
_HALF_KEYS = "SELECT *, c_custkey * 2 AS c_key FROM customer"


@query("join_full", f"SELECT * FROM orders FULL OUTER JOIN ({_HALF_KEYS}) c ON o_custkey = c_key")
def join_full(spark, d):
    c = table(spark, d, "customer").withColumn("c_key", F.col("c_custkey") * 2)
    return join(table(spark, d, "orders"), c, "o_custkey", "c_key", "full")


@query("join_right", f"SELECT * FROM orders RIGHT JOIN ({_HALF_KEYS}) c ON o_custkey = c_key")
def join_right(spark, d):
    c = table(spark, d, "customer").withColumn("c_key", F.col("c_custkey") * 2)
    return join(table(spark, d, "orders"), c, "o_custkey", "c_key", "right")


@query("join_suffixes", """
SELECT o.orderkey, o.price AS price_L, o.flag AS flag_L, l.price AS price_R, l.flag AS flag_R, l.line
FROM (SELECT o_orderkey AS orderkey, o_totalprice AS price, o_orderstatus AS flag FROM orders) o
JOIN (SELECT l_orderkey AS orderkey, l_extendedprice AS price, l_returnflag AS flag, l_linenumber AS line
      FROM lineitem) l ON o.orderkey = l.orderkey""")
def join_suffixes(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS orderkey", "o_totalprice AS price",
                                             "o_orderstatus AS flag")
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS orderkey", "l_extendedprice AS price",
                                                "l_returnflag AS flag", "l_linenumber AS line")
    return join(o, li, "orderkey", "orderkey", "inner")


@query("join_select", """
SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_select(spark, d):
    return join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", "inner",
                select=["o_orderkey", "o_totalprice", "c_name", "c_mktsegment"])


@query("join_semi", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders "
                    "WHERE o_totalprice > 450000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 450000")
    return join(table(spark, d, "customer"), o, "c_custkey", "o_custkey", "semi")


@query("join_natural", """
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_quantity, b.l_extendedprice
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) a
LEFT JOIN (SELECT l_orderkey, l_linenumber + 1 AS l_linenumber, l_partkey, l_extendedprice FROM lineitem) b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey""")
def join_natural(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    b = li.selectExpr("l_orderkey", "l_linenumber + 1 AS l_linenumber", "l_partkey", "l_extendedprice")
    return natural_join(a, b)


@query("vlookup_join", """
SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def vlookup_join_q(spark, d):
    return vlookup_join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")


@query("lookup_first", """
SELECT o.*, l.l_partkey FROM orders o LEFT JOIN (
  SELECT l_orderkey, l_partkey FROM (
    SELECT l_orderkey, l_partkey,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn
    FROM lineitem) WHERE rn = 1) l ON o.o_orderkey = l.l_orderkey""")
def lookup_first(spark, d):
    return lookup_column(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey",
                         "l_orderkey", "l_partkey", "first",
                         order_by=["l_linenumber", "l_partkey", "l_quantity"])


@query("lookup_agg", """
SELECT o.*, round(l.s, 2) AS l_quantity FROM orders o LEFT JOIN (
  SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""")
def lookup_agg(spark, d):
    out = lookup_column(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey",
                        "l_orderkey", "l_quantity", "sum")
    return out.withColumn("l_quantity", F.round("l_quantity", 2))


@query("stack", """
SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderstatus FROM orders
UNION ALL
SELECT o_orderkey, NULL::DOUBLE, o_orderstatus FROM orders""")
def stack_q(spark, d):
    o = table(spark, d, "orders")
    return stack(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus"))


@query("concat_cols", """
WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS p FROM customer),
     s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS p FROM supplier)
SELECT c_custkey, c_name, s_suppkey, s_name, coalesce(c.p, s.p) AS row_position
FROM c FULL OUTER JOIN s ON c.p = s.p""")
def concat_cols(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    out = concat_columns(c, s, [("c_acctbal", False), "c_custkey"], [("s_acctbal", False), "s_suppkey"])
    return out.select("c_custkey", "c_name", "s_suppkey", "s_name", "row_position")


_NULL_LINE = "CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE l_linenumber END"


@query("lookup_null_order", f"""
SELECT o.*, l.l_partkey FROM orders o LEFT JOIN (
  SELECT l_orderkey, l_partkey FROM (
    SELECT l_orderkey, l_partkey, row_number() OVER (
      PARTITION BY l_orderkey ORDER BY {_NULL_LINE} NULLS LAST, l_partkey, l_quantity) AS rn
    FROM lineitem) WHERE rn = 1) l ON o.o_orderkey = l.l_orderkey""")
def lookup_null_order(spark, d):
    li = table(spark, d, "lineitem").withColumn("line", F.expr(_NULL_LINE))
    return lookup_column(table(spark, d, "orders"), li, "o_orderkey", "l_orderkey", "l_partkey", "first",
                         order_by=["line", "l_partkey", "l_quantity"])


_NULL_BAL = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END"


@query("concat_null_order", f"""
WITH c AS (SELECT c_custkey, {_NULL_BAL} AS bal,
                  row_number() OVER (ORDER BY {_NULL_BAL} DESC NULLS LAST, c_custkey) AS p FROM customer),
     s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier)
SELECT c_custkey, bal, s_suppkey, coalesce(c.p, s.p) AS row_position FROM c FULL OUTER JOIN s ON c.p = s.p""")
def concat_null_order(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr(_NULL_BAL).alias("bal"))
    s = table(spark, d, "supplier").select("s_suppkey")
    return concat_columns(c, s, [("bal", False), "c_custkey"], ["s_suppkey"])
