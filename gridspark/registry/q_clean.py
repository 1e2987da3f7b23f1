"""Cleaning queries."""

from pyspark.sql import functions as F

from gridspark.operators import clean as C
from gridspark.operators.issues import apply_fix
from gridspark.registry.base import query, table

# orders with nulls made from values (no nulls exist in the driver tables)
_PRICE = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END"
_PRIO = "nullif(o_orderpriority, '5-LOW')"


def _orders_nulls(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.expr(_PRICE).alias("price"), F.expr(_PRIO).alias("prio"),
        "o_orderdate")


_ON = f"o_orderkey, o_custkey, {_PRICE} AS price, {_PRIO} AS prio, o_orderdate"

_EV_VALUE = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"


@query("dropna", f"SELECT * FROM (SELECT {_ON} FROM orders) WHERE price IS NOT NULL AND prio IS NOT NULL")
def dropna(spark, d):
    return C.drop_nulls(_orders_nulls(spark, d), ["price", "prio"])


@query("fill_value", f"""
SELECT o_orderkey, o_custkey, coalesce(price, 0.0) AS price, coalesce(prio, 'unknown') AS prio, o_orderdate
FROM (SELECT {_ON} FROM orders)""")
def fill_value(spark, d):
    return C.fill_value(C.fill_value(_orders_nulls(spark, d), 0, ["price"]), "unknown", ["prio"])


@query("fill_mean", f"""
SELECT o_orderkey, o_custkey, round(coalesce(price, (SELECT avg(price) FROM (SELECT {_PRICE} AS price FROM orders))), 4)
       AS price, prio, o_orderdate
FROM (SELECT {_ON} FROM orders)""")
def fill_mean(spark, d):
    return C.fill_stat(_orders_nulls(spark, d), ["price"], "mean").withColumn("price", F.round("price", 4))


@query("fill_median", f"""
SELECT event_id, user_id, round(coalesce(value, (SELECT quantile_cont({_EV_VALUE}, 0.5) FROM events)), 4) AS value
FROM (SELECT event_id, user_id, {_EV_VALUE} AS value FROM events)""")
def fill_median(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", F.expr(_EV_VALUE).alias("value"))
    return C.fill_stat(ev, ["value"], "median").withColumn("value", F.round("value", 4))


@query("fill_mode", f"""
WITH t AS (SELECT {_ON} FROM orders),
m AS (SELECT prio FROM t WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)
SELECT o_orderkey, o_custkey, price, coalesce(t.prio, (SELECT prio FROM m)) AS prio, o_orderdate FROM t""")
def fill_mode(spark, d):
    return C.fill_stat(_orders_nulls(spark, d), ["prio"], "mode")


@query("blank_to_null", """
SELECT o_orderkey, nullif(CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END, '') AS prio
FROM orders""")
def blank_to_null(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END").alias("prio"))
    return C.blank_to_null(o)


@query("ffill", f"""
SELECT event_id, ts, user_id, event_type,
       last_value({_EV_VALUE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events""")
def ffill(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type",
                                          F.expr(_EV_VALUE).alias("value"))
    return C.forward_fill(ev, ["value"], ["ts", "event_id"], ["user_id"])


@query("ffill_bucketed", f"""
SELECT event_id, ts, user_id, event_type,
       last_value({_EV_VALUE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events""")
def ffill_bucketed(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type",
                                          F.expr(_EV_VALUE).alias("value"))
    return C.forward_fill(ev, ["value"], ["ts", "event_id"], ["user_id"], strategy="positions")


@query("ffill_global_bucketed", f"""
SELECT event_id, ts, event_type,
       last_value({_EV_VALUE} IGNORE NULLS) OVER (ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events""")
def ffill_global_bucketed(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", "event_type", F.expr(_EV_VALUE).alias("value"))
    return C.forward_fill(ev, ["value"], ["ts", "event_id"], strategy="positions")


@query("ffill_global", f"""
SELECT event_id, ts, event_type,
       last_value({_EV_VALUE} IGNORE NULLS) OVER (ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events""")
def ffill_global(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", "event_type", F.expr(_EV_VALUE).alias("value"))
    return C.forward_fill(ev, ["value"], ["ts", "event_id"])


@query("drop_empty_columns", """
SELECT o_orderkey, o_orderstatus FROM orders""")
def drop_empty_columns(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_totalprice < 0 THEN o_orderpriority END").alias("never"),
        "o_orderstatus")
    return C.drop_empty_columns(o)


@query("blank_flags", f"""
SELECT *, price IS NULL AS price_is_blank, prio IS NULL AS prio_is_blank FROM (SELECT {_ON} FROM orders)""")
def blank_flags(spark, d):
    return C.blank_flags(_orders_nulls(spark, d), ["price", "prio"])


@query("dedupe_keep_first", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity,
                                l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedupe_keep_first(spark, d):
    return C.dedupe(table(spark, d, "lineitem"), ["l_orderkey"],
                    order_by=["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])


@query("dedupe_all", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedupe_all(spark, d):
    return C.dedupe(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


# raw text built from driver columns, the same on both sides
_RAW_INT_SQL = ("CASE WHEN o_orderstatus = 'P' THEN 'n/a' "
                "WHEN o_orderpriority = '1-URGENT' THEN '$' || CAST(o_custkey AS STRING) || '.00' "
                "WHEN o_orderpriority = '2-HIGH' THEN ' ' || CAST(o_custkey AS STRING) || '% ' "
                "WHEN o_orderpriority = '3-MEDIUM' THEN CAST(o_totalprice AS STRING) "
                "ELSE CAST(o_orderkey AS STRING) END")


@query("cast_clean_int", f"""
SELECT o_orderkey, CASE WHEN n = floor(n) THEN CAST(n AS BIGINT) END AS raw
FROM (SELECT o_orderkey, TRY_CAST(regexp_replace({_RAW_INT_SQL}, '[$,%\\s]', '', 'g') AS DOUBLE) AS n FROM orders)""")
def cast_clean_int(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_INT_SQL).alias("raw"))
    return C.cast_column(o, "raw", "int")


@query("cast_float_try", f"""
SELECT o_orderkey, TRY_CAST({_RAW_INT_SQL} AS DOUBLE) AS raw FROM orders""")
def cast_float_try(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_INT_SQL).alias("raw"))
    return C.cast_column(o, "raw", "float")


@query("cast_report", f"""
SELECT count(*) AS rows,
       count(*) FILTER (WHERE TRY_CAST({_RAW_INT_SQL} AS DOUBLE) IS NULL) AS failed FROM orders""")
def cast_report(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_INT_SQL).alias("raw"))
    return C.cast_report(o, "raw", "float")


_RAW_BOOL_SQL = ("CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN ' off ' ELSE 'maybe' END")


@query("cast_bool", f"""
SELECT o_orderkey, CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes', 'y', 't', 'on') THEN true
                        WHEN lower(trim(raw)) IN ('false', '0', 'no', 'n', 'f', 'off') THEN false END AS raw
FROM (SELECT o_orderkey, {_RAW_BOOL_SQL} AS raw FROM orders)""")
def cast_bool(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_BOOL_SQL).alias("raw"))
    return C.cast_column(o, "raw", "bool")


_RAW_DATE_SPARK = ("CASE WHEN o_orderstatus = 'P' THEN 'junk' "
                   "WHEN o_orderpriority = '1-URGENT' THEN date_format(o_orderdate, 'MM/dd/yyyy') "
                   "ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END")
_RAW_DATE_DUCK = ("CASE WHEN o_orderstatus = 'P' THEN 'junk' "
                  "WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%m/%d/%Y') "
                  "ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END")


@query("cast_date", f"""
SELECT o_orderkey, coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y')) AS raw
FROM (SELECT o_orderkey, {_RAW_DATE_DUCK} AS raw FROM orders)""")
def cast_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_DATE_SPARK).alias("raw"))
    return C.cast_column(o, "raw", "date")


@query("cast_date_format", f"""
SELECT o_orderkey, try_strptime(raw, '%m/%d/%Y') AS raw
FROM (SELECT o_orderkey, {_RAW_DATE_DUCK} AS raw FROM orders)""")
def cast_date_format(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_DATE_SPARK).alias("raw"))
    return C.cast_column(o, "raw", "date", fmt="MM/dd/yyyy")


@query("cast_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def cast_text(spark, d):
    return C.cast_column(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "text")


@query("replace_exact", """
SELECT p_partkey, p_name, CASE WHEN lower(p_type) = 'economy' THEN 'ECO' ELSE p_type END AS p_type FROM part""")
def replace_exact(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return C.find_replace(p, "economy", "ECO", ["p_type"], mode="exact")


@query("replace_contains_ci", """
SELECT p_partkey, regexp_replace(p_name, 'red', 'cr$1mson', 'gi') AS p_name, p_brand FROM part""")
def replace_contains_ci(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return C.find_replace(p, "RED", "cr$1mson", ["p_name"], mode="contains")


@query("replace_all_columns", """
SELECT p_partkey, regexp_replace(p_name, 'Brand#1', 'B1', 'g') AS p_name,
       regexp_replace(p_brand, 'Brand#1', 'B1', 'g') AS p_brand, regexp_replace(p_type, 'Brand#1', 'B1', 'g') AS p_type,
       p_size, p_retailprice FROM part""")
def replace_all_columns(spark, d):
    return C.find_replace(table(spark, d, "part"), "Brand#1", "B1", mode="contains", case=True)


@query("replace_regex", r"""
SELECT p_partkey, regexp_replace(p_brand, 'Brand#(\d+)', 'B-\1', 'g') AS p_brand FROM part""")
def replace_regex(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return C.find_replace(p, r"Brand#(\d+)", "B-$1", ["p_brand"], mode="regex", case=True)


@query("replace_first", """
WITH f AS (SELECT min(p_partkey) AS k FROM part WHERE contains(lower(p_name), 'ring'))
SELECT p_partkey, CASE WHEN p_partkey = (SELECT k FROM f)
                       THEN regexp_replace(p_name, 'ring', 'RING', 'gi') ELSE p_name END AS p_name
FROM part""")
def replace_first(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return C.replace_first(p, "ring", "RING", "p_name", ["p_partkey"])


@query("match_counts", """
SELECT 'p_name' AS "column", count(*) FILTER (WHERE contains(lower(p_name), 'ring')) AS matches FROM part
UNION ALL SELECT 'p_brand', count(*) FILTER (WHERE contains(lower(p_brand), 'ring')) FROM part
UNION ALL SELECT 'p_size', count(*) FILTER (WHERE contains(lower(CAST(p_size AS VARCHAR)), 'ring')) FROM part""")
def match_counts(spark, d):
    p = table(spark, d, "part").select("p_name", "p_brand", "p_size")
    return C.match_counts(p, "RING")


@query("match_preview", """
SELECT p_name AS before, regexp_replace(p_name, 'ring', 'loop', 'gi') AS after FROM part
WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 5""")
def match_preview(spark, d):
    return C.match_preview(table(spark, d, "part"), "ring", "loop", "p_name", order_by=["p_partkey"])


@query("cell_update", """
SELECT o_orderkey, CASE WHEN o_orderkey = 42 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
FROM orders""")
def cell_update(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return C.update_cells(o, "o_orderkey", 42, "o_orderstatus", "X")


@query("cell_update_batch", """
SELECT o.o_orderkey, coalesce(e.st, o.o_orderstatus) AS o_orderstatus, o.o_totalprice
FROM orders o LEFT JOIN (SELECT o_orderkey AS k, 'E' AS st FROM orders WHERE o_totalprice > 450000) e
  ON o.o_orderkey = e.k""")
def cell_update_batch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    edits = o.where("o_totalprice > 450000").select("o_orderkey", F.lit("E").alias("o_orderstatus"))
    return C.apply_edits(o, edits, "o_orderkey")


_NULL_TS = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END"


def _ffill_null_order(strategy):
    @query(f"ffill_null_order_{strategy}", f"""
SELECT event_id, event_type, last_value({_EV_VALUE} IGNORE NULLS) OVER (
         PARTITION BY event_type ORDER BY {_NULL_TS} NULLS LAST, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events""")
    def run(spark, d):
        ev = table(spark, d, "events").select("event_id", "event_type", F.expr(_NULL_TS).alias("at"),
                                              F.expr(_EV_VALUE).alias("value"))
        return C.forward_fill(ev, ["value"], ["at", "event_id"], ["event_type"], strategy=strategy).drop("at")
    return run


for _s in ("window", "positions"):
    _ffill_null_order(_s)

_NULL_QTY = "CASE WHEN l_quantity < 30 THEN NULL ELSE l_quantity END"


@query("dedupe_null_order", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, qty FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {_NULL_QTY} AS qty, row_number() OVER (
    PARTITION BY l_suppkey ORDER BY {_NULL_QTY} NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedupe_null_order(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", f"{_NULL_QTY} AS qty")
    return C.dedupe(li, ["l_suppkey"], order_by=["qty", "l_orderkey", "l_linenumber", "l_partkey"])


@query("replace_first_null_order", """
WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 1 THEN NULL ELSE p_partkey END AS ord FROM part),
f AS (SELECT p_partkey AS k FROM p WHERE contains(lower(p_name), 'ring') ORDER BY ord NULLS LAST, p_partkey LIMIT 1)
SELECT p_partkey, ord, CASE WHEN p_partkey = (SELECT k FROM f)
                       THEN regexp_replace(p_name, 'ring', 'RING', 'gi') ELSE p_name END AS p_name FROM p""")
def replace_first_null_order(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_name",
                                           "CASE WHEN p_partkey % 2 = 1 THEN NULL ELSE p_partkey END AS ord")
    return C.replace_first(p, "ring", "RING", "p_name", ["ord", "p_partkey"])


@query("fill_all_columns", """
SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END, 0) AS o_orderkey, o_custkey, o_orderstatus,
       coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END, 0) AS o_totalprice,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, o_orderpriority FROM orders""")
def fill_all_columns(spark, d):
    o = table(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey", "o_custkey", "o_orderstatus",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate", "o_orderpriority")
    return C.fill_value(o, 0)


@query("issue_fix_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders""")
def issue_fix_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "not a day").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"))
    return apply_fix(o, "day", "date_like_strings")


@query("issue_fix_high_nulls", "SELECT c_custkey, c_name FROM customer")
def issue_fix_high_nulls(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 9 == 0, 1).alias("rare"))
    return apply_fix(c, "rare", "high_nulls")


@query("issue_fix_unique", "SELECT s_suppkey, s_name, true AS s_suppkey_is_id FROM supplier")
def issue_fix_unique(spark, d):
    return apply_fix(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "unique_values")
