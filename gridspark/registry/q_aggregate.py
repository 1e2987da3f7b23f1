"""Aggregation queries."""

from pyspark.sql import functions as F

from gridspark.operators import aggregate as A
from gridspark.operators.wide import corr_pairs
from gridspark.plans.ordered import exact_quantiles
from gridspark.registry.base import query, table


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count_q(spark, d):
    return A.row_count(table(spark, d, "lineitem"))


@query("agg_count_by", 'SELECT l_returnflag, count(*) AS "Count" FROM lineitem GROUP BY 1')
def agg_count_by(spark, d):
    return A.count_by(table(spark, d, "lineitem"), "l_returnflag")


@query("agg_sum_by", """
SELECT l_returnflag, round(coalesce(sum(l_quantity), 0), 2) AS Sum_l_quantity
FROM lineitem GROUP BY 1""")
def agg_sum_by(spark, d):
    out = A.sum_by(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return out.withColumn("Sum_l_quantity", F.round("Sum_l_quantity", 2))


@query("agg_sum_all_null_group", """
SELECT o_orderstatus,
       round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END), 0)::DOUBLE, 2) AS Sum_price
FROM orders GROUP BY 1""")
def agg_sum_all_null_group(spark, d):
    o = table(spark, d, "orders").withColumn(
        "price", F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END"))
    out = A.sum_by(o, "o_orderstatus", "price")
    return out.withColumn("Sum_price", F.round("Sum_price", 2).cast("double"))


@query("agg_avg_by", """
SELECT l_linestatus, round_even(avg(l_extendedprice), 2) AS Avg_l_extendedprice
FROM lineitem GROUP BY 1""")
def agg_avg_by(spark, d):
    return A.avg_by(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice")


def _r4(df, *cols):
    """Round float results to 4 decimals (both sides of the oracle do)."""
    return df.select(*[F.round(c, 4).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("agg_median_by", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_l_extendedprice
FROM lineitem GROUP BY 1""")
def agg_median_by(spark, d):
    out = A.custom_agg(table(spark, d, "lineitem"), "l_extendedprice", "median", key="l_returnflag")
    return _r4(out, "median_l_extendedprice")


@query("agg_median_by_bucketed", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_l_extendedprice
FROM lineitem GROUP BY 1""")
def agg_median_by_bucketed(spark, d):
    out = A.custom_agg(table(spark, d, "lineitem"), "l_extendedprice", "median", key="l_returnflag",
                       strategy="positions")
    return _r4(out, "median_l_extendedprice")


@query("agg_median_by_brackets", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_l_extendedprice
FROM lineitem GROUP BY 1""")
def agg_median_by_brackets(spark, d):
    out = A.custom_agg(table(spark, d, "lineitem"), "l_extendedprice", "median", key="l_returnflag",
                       strategy="brackets")
    return _r4(out, "median_l_extendedprice")


@query("quantiles_brackets_hot", """
WITH t AS (SELECT l_linestatus, CASE WHEN l_orderkey % 3 = 0 THEN 30000 WHEN l_orderkey % 7 = 0 THEN NULL
                                     ELSE l_extendedprice END AS v FROM lineitem),
q AS (SELECT l_linestatus, unnest([0.01, 0.25, 0.5, 0.9, 0.99]) AS q,
             unnest(quantile_cont(v, [0.01, 0.25, 0.5, 0.9, 0.99])) AS value FROM t GROUP BY 1)
SELECT l_linestatus, CAST(q AS DOUBLE) AS q, round(value, 4) AS value FROM q""")
def quantiles_brackets_hot(spark, d):
    hot = F.when(F.col("l_orderkey") % 3 == 0, 30000.0).when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(
        F.col("l_extendedprice"))
    out = exact_quantiles(table(spark, d, "lineitem").withColumn("v", hot), "v", [0.01, 0.25, 0.5, 0.9, 0.99],
                          ["l_linestatus"], strategy="brackets")
    return _r4(out, "value")


@query("agg_median_all", "SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS median_o_totalprice FROM orders")
def agg_median_all(spark, d):
    return _r4(A.custom_agg(table(spark, d, "orders"), "o_totalprice", "median"), "median_o_totalprice")


@query("agg_custom_max", "SELECT o_orderpriority, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1")
def agg_custom_max(spark, d):
    return A.custom_agg(table(spark, d, "orders"), "o_totalprice", "max", key="o_orderpriority")


@query("agg_multi", """
SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity,
       round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_discount), 2) AS sum_l_discount
FROM lineitem GROUP BY 1""")
def agg_multi(spark, d):
    out = A.agg_multi(table(spark, d, "lineitem"), "l_returnflag",
                      ["l_quantity", "l_extendedprice", "l_discount"], "sum")
    return out.select("l_returnflag", *[F.round(c, 2).alias(c) for c in out.columns[1:]])


@query("agg_map", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity,
       round(avg(l_discount), 6) AS l_discount, count(l_orderkey) AS l_orderkey,
       round(quantile_cont(l_tax, 0.5), 4) AS l_tax, count(DISTINCT l_suppkey) AS l_suppkey
FROM lineitem GROUP BY 1, 2""")
def agg_map(spark, d):
    out = A.agg_map(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"],
                    {"l_quantity": "sum", "l_discount": "mean", "l_orderkey": "count",
                     "l_tax": "median", "l_suppkey": "nunique"})
    return out.withColumn("l_quantity", F.round("l_quantity", 2)).withColumn(
        "l_discount", F.round("l_discount", 6)).withColumn("l_tax", F.round("l_tax", 4))


@query("group_summary", """
SELECT o_orderstatus, o_orderpriority, count(*) AS "Count" FROM orders GROUP BY 1, 2""")
def group_summary_q(spark, d):
    return A.group_summary(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("group_summary_mean", """
SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 4) AS mean_c_acctbal
FROM customer GROUP BY 1, 2""")
def group_summary_mean(spark, d):
    out = A.group_summary(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "mean", "c_acctbal")
    return out.withColumn("mean_c_acctbal", F.round("mean_c_acctbal", 4))


@query("distinct_counts", """
SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem""")
def distinct_counts_q(spark, d):
    return A.distinct_counts(table(spark, d, "lineitem"),
                             ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"])


@query("value_counts", """
SELECT p_type, count(*) AS "count" FROM part WHERE p_type IS NOT NULL GROUP BY 1""")
def value_counts_q(spark, d):
    return A.value_counts(table(spark, d, "part"), "p_type")


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows_q(spark, d):
    return A.distinct_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def _stats_sql(table_name, cols, qs, digits=None):
    parts = []
    for c in cols:
        exprs = [f"count({c}) AS count", f"avg({c}) AS mean", f"stddev_samp({c}) AS std",
                 f"min({c})::DOUBLE AS min"]
        for q in qs:
            exprs.append(f"quantile_cont({c}, {q}) AS p{round(q * 100)}")
        exprs.append(f"max({c})::DOUBLE AS max")
        if digits is not None:
            exprs = [exprs[0]] + [f"round({e.split(' AS ')[0]}, {digits}) AS {e.split(' AS ')[1]}"
                                  for e in exprs[1:]]
        parts.append(f"SELECT '{c}' AS \"column\", " + ", ".join(exprs) + f" FROM {table_name}")
    return "\nUNION ALL ".join(parts)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


_DESC = ("mean", "std", "min", "p25", "p50", "p75", "max")


@query("describe", _stats_sql("lineitem", _LI_NUM, [0.25, 0.5, 0.75], digits=4))
def describe_q(spark, d):
    return _r4(A.describe(table(spark, d, "lineitem"), _LI_NUM), *_DESC)


@query("describe_bucketed", _stats_sql("lineitem", _LI_NUM, [0.25, 0.5, 0.75], digits=4))
def describe_bucketed(spark, d):
    return _r4(A.describe(table(spark, d, "lineitem"), _LI_NUM, strategy="positions"), *_DESC)


@query("describe_brackets", _stats_sql("lineitem", _LI_NUM, [0.25, 0.5, 0.75], digits=4))
def describe_brackets(spark, d):
    return _r4(A.describe(table(spark, d, "lineitem"), _LI_NUM, strategy="brackets"), *_DESC)


@query("describe_null_column", """
WITH t AS (SELECT CASE WHEN o_orderkey < 0 THEN o_totalprice END AS none, o_custkey FROM orders)
SELECT 'none' AS "column", count(none) AS count, avg(none) AS mean, stddev_samp(none) AS std, min(none)::DOUBLE AS min,
       quantile_cont(none, 0.25)::DOUBLE AS p25, quantile_cont(none, 0.5)::DOUBLE AS p50,
       quantile_cont(none, 0.75)::DOUBLE AS p75, max(none)::DOUBLE AS max FROM t
UNION ALL
SELECT 'o_custkey', count(o_custkey), round(avg(o_custkey), 4), round(stddev_samp(o_custkey), 4), min(o_custkey),
       quantile_cont(o_custkey, 0.25), quantile_cont(o_custkey, 0.5), quantile_cont(o_custkey, 0.75), max(o_custkey) FROM t""")
def describe_null_column(spark, d):
    t = table(spark, d, "orders").select(F.when(F.col("o_orderkey") < 0, F.col("o_totalprice")).alias("none"), "o_custkey")
    return _r4(A.describe(t), *_DESC)


@query("stats_percentiles", _stats_sql("orders", ["o_totalprice", "o_custkey"],
                                       [0.1, 0.25, 0.5, 0.75, 0.9, 0.95], digits=4))
def stats_percentiles(spark, d):
    return A.column_stats(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])


@query("null_counts", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
                  nullif(o_orderpriority, '5-LOW') AS prio FROM orders)
SELECT 'o_orderkey' AS "column", count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls FROM t
UNION ALL SELECT 'price', count(*) FILTER (WHERE price IS NULL) FROM t
UNION ALL SELECT 'prio', count(*) FILTER (WHERE prio IS NULL) FROM t""")
def null_counts_q(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END").alias("price"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"))
    return A.null_counts(o)


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", "\nUNION ALL ".join(
    f"SELECT '{a}' AS \"column\", " + ", ".join(f"round(corr({a}, {b}), 6) AS {b}" for b in _CORR)
    + " FROM lineitem" for a in _CORR))
def corr_matrix_q(spark, d):
    out = A.corr_matrix(table(spark, d, "lineitem"), _CORR)
    return out.select("column", *[F.round(c, 6).alias(c) for c in _CORR])


# every other tax and every third discount is missing, so that pairs differ in their rows
_WIDE = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice",
         "l_discount": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END",
         "l_tax": "CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_tax END",
         "l_partkey": "CAST(l_partkey AS DOUBLE)", "l_linenumber": "CAST(l_linenumber AS DOUBLE)"}


@query("corr_pairs", "WITH t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM lineitem)\n"
       + "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {b} IS NOT NULL THEN {a} END) AS n, "
                             f"round(corr({a}, {b}), 6) AS corr FROM t"
                             for i, a in enumerate(_WIDE) for b in list(_WIDE)[i:]))
def corr_pairs_q(spark, d):
    t = table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in _WIDE.items()])
    return corr_pairs(t, block=4).withColumn("corr", F.round("corr", 6))


@query("corr_pairs_embeddings", """
WITH t AS (SELECT row_number() OVER () AS r, embedding FROM embeddings),
u AS (SELECT r, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM t, range(64) AS g(i)),
p AS (SELECT a.i AS i, b.i AS j, count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) AS n, corr(a.x, b.x) AS corr
      FROM u AS a JOIN u AS b ON a.r = b.r AND a.i <= b.i GROUP BY 1, 2)
SELECT 'x' || i AS a, 'x' || j AS b, n, round(corr, 6) AS corr FROM p""")
def corr_pairs_embeddings(spark, d):
    """Every pair of the 64 components of the vectors, as columns of a wide table."""
    t = table(spark, d, "embeddings").select(*[F.get("embedding", F.lit(i)).alias(f"x{i}") for i in range(64)])
    return corr_pairs(t, block=24).withColumn("corr", F.round("corr", 6))


@query("conversations_role_counts", 'SELECT role, count(*) AS "Count" FROM conversations GROUP BY 1')
def conversations_role_counts(spark, d):
    return A.count_by(table(spark, d, "conversations"), "role")


@query("documents_lang_stats", """
SELECT lang, count(n_chars) AS count_n_chars, round(avg(n_chars), 4) AS mean_n_chars,
       round(quantile_cont(n_chars, 0.5), 4) AS median_n_chars, max(n_chars) AS max_n_chars
FROM documents GROUP BY 1""")
def documents_lang_stats(spark, d):
    out = A.aggregate(table(spark, d, "documents"), ["lang"],
                      [("n_chars", "count", "count_n_chars"), ("n_chars", "mean", "mean_n_chars"),
                       ("n_chars", "median", "median_n_chars"), ("n_chars", "max", "max_n_chars")])
    return _r4(out, "mean_n_chars", "median_n_chars")
