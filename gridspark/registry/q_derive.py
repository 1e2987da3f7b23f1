"""Derived-column queries."""

from pyspark.sql import functions as F

from gridspark.operators import derive as X
from gridspark.registry.base import query, table


@query("formula", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
FROM lineitem""")
def formula_q(spark, d):
    li = table(spark, d, "lineitem")
    out = X.formula(li, "charge", "`l_extendedprice` * (1 - `l_discount`) * (1 + `l_tax`)")
    return out.select("l_orderkey", "l_linenumber", "charge")


@query("if_then_else", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class
FROM lineitem""")
def if_then_else_q(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return X.if_then_else(li, "size_class", "l_quantity > 25", "big", "small").drop("l_quantity")


@query("if_then_column", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS billed FROM orders""")
def if_then_column_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return X.if_then_else(o, "billed", "o_orderstatus = 'F'", "`o_totalprice`", 0.0).select(
        "o_orderkey", "billed")


@query("condition_count", """
SELECT count(*) FILTER (WHERE l_discount >= 0.05 AND l_returnflag = 'R') AS matches, count(*) AS rows
FROM lineitem""")
def condition_count_q(spark, d):
    return X.condition_count(table(spark, d, "lineitem"), "l_discount >= 0.05 AND l_returnflag = 'R'")


@query("map_values", """
SELECT o_orderkey, CASE trim(o_orderstatus) WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open'
                    ELSE 'Other' END AS status_name FROM orders""")
def map_values_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return X.map_values(o, "o_orderstatus", {"F": "Finished", "O": "Open"}, default="Other",
                        name="status_name").drop("o_orderstatus")


@query("map_values_table", """
SELECT c_custkey, coalesce(n.n_name, CAST(c.c_nationkey AS VARCHAR)) AS c_nationkey
FROM customer c LEFT JOIN nation n ON trim(CAST(c.c_nationkey AS VARCHAR)) = trim(CAST(n.n_nationkey AS VARCHAR))""")
def map_values_table_q(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return X.map_values_table(c, "c_nationkey", table(spark, d, "nation"), "n_nationkey", "n_name")


@query("text_steps", """
SELECT p_partkey, CAST(length(upper(regexp_replace(p_type, '^\\s+|\\s+$', '', 'g'))) AS INTEGER) AS n, upper(p_name) AS p_name
FROM part""")
def text_steps_q(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    p = X.transform_column(p, "p_type", ["strip", "upper", "len"], name="n")
    return X.transform_column(p, "p_name", ["upper"]).drop("p_type")


_RAW_NUM = ("CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'n/a' "
            "ELSE '$' || CAST(c_acctbal AS STRING) END")


@query("text_steps_numbers", """
SELECT c_custkey,
       round_even(coalesce(TRY_CAST(regexp_replace(raw, '[$,%\\s]', '', 'g') AS DOUBLE), 0.0), 1) AS raw,
       TRY_CAST(CAST(c_nationkey AS VARCHAR) AS DOUBLE) AS nation_f,
       CASE WHEN TRY_CAST(regexp_replace(CAST(c_custkey AS VARCHAR) || '%', '[$,%\\s]', '', 'g') AS DOUBLE)
                 = floor(TRY_CAST(regexp_replace(CAST(c_custkey AS VARCHAR) || '%', '[$,%\\s]', '', 'g') AS DOUBLE))
            THEN CAST(TRY_CAST(regexp_replace(CAST(c_custkey AS VARCHAR) || '%', '[$,%\\s]', '', 'g') AS DOUBLE) AS BIGINT)
       END AS key_i
FROM (SELECT c_custkey, c_nationkey, """ + _RAW_NUM.replace("STRING", "VARCHAR") + """ AS raw FROM customer)""")
def text_steps_numbers_q(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.expr(_RAW_NUM).alias("raw"),
        F.col("c_nationkey").cast("string").alias("nation_f"),
        F.concat(F.col("c_custkey").cast("string"), F.lit("%")).alias("key_i"))
    c = X.transform_column(c, "raw", ["clean_number", ("fill", 0.0), ("round", 1)])
    c = X.transform_column(c, "nation_f", ["float"])
    return X.transform_column(c, "key_i", ["int"])


@query("text_steps_dates", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d, CAST(length(o_orderpriority) AS INTEGER) AS n FROM orders""")
def text_steps_dates_q(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderpriority")
    o = X.transform_column(o, "d", ["date"])
    return X.transform_column(o, "o_orderpriority", ["len"], name="n").drop("o_orderpriority")


@query("regex_extract", r"""
SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '#(\d+)') THEN regexp_extract(p_brand, '#(\d+)', 1) END
       AS brand_no FROM part""")
def regex_extract_q(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return X.transform_column(p, "p_brand", [("extract", r"#(\d+)")], name="brand_no").drop("p_brand")


@query("round_half_even", """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 1) AS q FROM lineitem""")
def round_half_even_q(spark, d):
    # quarters are exact binary fractions, so half-way ties really occur
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                            (F.col("l_quantity") / 4).alias("q"))
    return X.round_column(li, "q", 1)


@query("date_parts", """
SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
       CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday,
       CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter
FROM orders""")
def date_parts_q(spark, d):
    return X.date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("day_diff", """
SELECT l.l_orderkey, l.l_linenumber,
       CAST(floor((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000.0) AS BIGINT) AS days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def day_diff_q(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return X.day_difference(j, "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "days")


@query("day_diff_now", """
SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-02-01 12:00:00')) / 86400000000.0) AS BIGINT)
       AS days FROM events""")
def day_diff_now_q(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts")
    return X.day_difference(ev, "ts", now="2024-02-01 12:00:00").select("event_id", "days")


@query("title_case", r"""
SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1),
         lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(p_name, i - 1, 1), '\p{L}')
                   THEN upper(substr(p_name, i, 1)) ELSE lower(substr(p_name, i, 1)) END), '') AS p_name
FROM part""")
def title_case_q(spark, d):
    return X.transform_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["title"])
