"""Filter queries."""

from pyspark.sql import functions as F

from gridspark.operators.filter import (filter_expr, filter_flag, filter_fuzzy_value,
                                        filter_multi, filter_rows, filter_stack)
from gridspark.registry.base import query, table

# text priority with real nulls and whitespace-only values, built the same
# way on both sides: 5-LOW -> NULL, 3-MEDIUM -> '   '
_PRIO_SQL = ("CASE WHEN o_orderpriority = '5-LOW' THEN NULL "
             "WHEN o_orderpriority = '3-MEDIUM' THEN '   ' ELSE o_orderpriority END")


def _orders_with_blanks(spark, d):
    return table(spark, d, "orders").withColumn("o_orderpriority", F.expr(_PRIO_SQL))


_ORD_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate"


@query("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, d):
    return filter_rows(table(spark, d, "orders"), "o_orderstatus", "==", "F")


@query("filter_ne_null", f"""
SELECT {_ORD_COLS}, {_PRIO_SQL} AS o_orderpriority FROM orders
WHERE ({_PRIO_SQL}) IS DISTINCT FROM '2-HIGH'""")
def filter_ne_null(spark, d):
    return filter_rows(_orders_with_blanks(spark, d), "o_orderpriority", "!=", "2-HIGH")


@query("filter_cmp", "SELECT * FROM lineitem WHERE l_quantity > 25")
def filter_cmp(spark, d):
    return filter_rows(table(spark, d, "lineitem"), "l_quantity", ">", "25")


@query("filter_cmp_le_date", "SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30 00:00:00'")
def filter_cmp_le_date(spark, d):
    return filter_rows(table(spark, d, "orders"), "o_orderdate", "<=", "1995-06-30 00:00:00")


@query("filter_between", "SELECT * FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05")
def filter_between(spark, d):
    return filter_rows(table(spark, d, "lineitem"), "l_discount", "between", "0.02-0.05")


@query("filter_contains", "SELECT * FROM part WHERE contains(lower(p_name), 'ring')")
def filter_contains(spark, d):
    return filter_rows(table(spark, d, "part"), "p_name", "contains", "RING")


@query("filter_not_contains", "SELECT * FROM part WHERE NOT coalesce(contains(lower(p_name), 'bolt'), false)")
def filter_not_contains(spark, d):
    return filter_rows(table(spark, d, "part"), "p_name", "not contains", "Bolt")


@query("filter_starts", "SELECT * FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def filter_starts(spark, d):
    return filter_rows(table(spark, d, "customer"), "c_name", "starts with", "Customer#00000001")


@query("filter_ends", "SELECT * FROM part WHERE ends_with(p_brand, '7')")
def filter_ends(spark, d):
    return filter_rows(table(spark, d, "part"), "p_brand", "ends with", "7")


@query("filter_regex", "SELECT * FROM part WHERE regexp_matches(p_name, '^(red|blue) ')")
def filter_regex(spark, d):
    return filter_rows(table(spark, d, "part"), "p_name", "regex", "^(red|blue) ")


@query("filter_contains_regex_ci", "SELECT * FROM part WHERE regexp_matches(p_name, '(?i)R[aeiou]NG$')")
def filter_contains_regex_ci(spark, d):
    return filter_rows(table(spark, d, "part"), "p_name", "contains", "R[aeiou]NG$", regex=True)


@query("filter_blank", f"""
SELECT {_ORD_COLS}, {_PRIO_SQL} AS o_orderpriority FROM orders
WHERE ({_PRIO_SQL}) IS NULL OR regexp_matches({_PRIO_SQL}, '^\\s*$')""")
def filter_blank(spark, d):
    return filter_rows(_orders_with_blanks(spark, d), "o_orderpriority", "is blank")


@query("filter_not_blank", f"""
SELECT {_ORD_COLS}, {_PRIO_SQL} AS o_orderpriority FROM orders
WHERE NOT (({_PRIO_SQL}) IS NULL OR regexp_matches({_PRIO_SQL}, '^\\s*$'))""")
def filter_not_blank(spark, d):
    return filter_rows(_orders_with_blanks(spark, d), "o_orderpriority", "is not blank")


@query("filter_is_null", f"""
SELECT {_ORD_COLS}, {_PRIO_SQL} AS o_orderpriority FROM orders WHERE ({_PRIO_SQL}) IS NULL""")
def filter_is_null(spark, d):
    return filter_rows(_orders_with_blanks(spark, d), "o_orderpriority", "is null")


@query("filter_in", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, d):
    return filter_rows(table(spark, d, "orders"), "o_orderpriority", "in", "1-URGENT, '2-HIGH'")


@query("filter_in_numeric", "SELECT * FROM lineitem WHERE l_linenumber IN (1, 3, 5)")
def filter_in_numeric(spark, d):
    return filter_rows(table(spark, d, "lineitem"), "l_linenumber", "is one of", "1,3,5")


@query("filter_not_in", f"""
SELECT {_ORD_COLS}, {_PRIO_SQL} AS o_orderpriority FROM orders
WHERE NOT coalesce(trim({_PRIO_SQL}) IN ('1-URGENT', '4-NOT SPECIFIED'), false)""")
def filter_not_in(spark, d):
    return filter_rows(_orders_with_blanks(spark, d), "o_orderpriority", "not in",
                       ["1-URGENT", "4-NOT SPECIFIED"])


@query("filter_multi", """
SELECT * FROM lineitem
WHERE ((l_quantity > 45 OR l_discount = 0.1) AND l_returnflag = 'R') OR l_tax >= 0.08""")
def filter_multi_q(spark, d):
    return filter_multi(table(spark, d, "lineitem"), [
        ("l_quantity", ">", 45),
        ("l_discount", "==", 0.1, "or"),
        ("l_returnflag", "==", "R", "and"),
        ("l_tax", ">=", 0.08, "or"),
    ])


@query("filter_stack", """
SELECT * FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity <= 10""")
def filter_stack_q(spark, d):
    return filter_stack(table(spark, d, "lineitem"), [
        ("l_returnflag", "==", "N"), ("l_linestatus", "==", "O"),
        ("l_shipmode", "==", "AIR"),  # column no longer present: skipped
        {"column": "l_quantity", "op": "<=", "value": 10},
    ])


@query("filter_flag", "SELECT * FROM labels WHERE quality = 1")
def filter_flag_q(spark, d):
    return filter_flag(table(spark, d, "labels"), "quality", keep=True)


@query("filter_flag_false", "SELECT * FROM labels WHERE toxic = 0")
def filter_flag_false_q(spark, d):
    return filter_flag(table(spark, d, "labels"), "toxic", keep=False)


@query("filter_expr", "SELECT * FROM lineitem WHERE l_quantity > 20 AND l_returnflag = 'A'")
def filter_expr_q(spark, d):
    return filter_expr(table(spark, d, "lineitem"), "l_quantity > 20 and l_returnflag == 'A'")


@query("filter_fuzzy", """
WITH s AS (
  SELECT v, 100.0 * (1 - levenshtein(lower(v), 'economi') / greatest(length(v), 7)) AS score
  FROM (SELECT DISTINCT p_type AS v FROM part)),
best AS (SELECT v FROM s WHERE score >= 60 ORDER BY score DESC, v LIMIT 1)
SELECT * FROM part WHERE p_type = (SELECT v FROM best)""")
def filter_fuzzy_q(spark, d):
    return filter_fuzzy_value(table(spark, d, "part"), "p_type", "economi", threshold=60)
