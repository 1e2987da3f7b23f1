"""Calendar grouping, binning and outlier queries."""

from pyspark.sql import functions as F

from gridspark.operators import bins as B
from gridspark.operators import outliers as U
from gridspark.operators import timeseries as T
from gridspark.registry.base import query, table


@query("period_sum_month", """
SELECT date_trunc('month', o_orderdate) AS period, round(sum(o_totalprice), 2) AS sum_o_totalprice
FROM orders GROUP BY 1""")
def period_sum_month(spark, d):
    out = T.period_aggregate(table(spark, d, "orders"), "o_orderdate", "month", "o_totalprice", "sum")
    return out.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("period_week", "SELECT date_trunc('week', ts) AS period, count(*) AS count FROM events GROUP BY 1")
def period_week(spark, d):
    return T.period_aggregate(table(spark, d, "events"), "ts", "week")


@query("period_day_mean", """
SELECT date_trunc('day', ts) AS period, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def period_day_mean(spark, d):
    out = T.period_aggregate(table(spark, d, "events"), "ts", "day", "value", "mean")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("period_quarter", """
SELECT date_trunc('quarter', l_shipdate) AS period, count(l_quantity) AS count_l_quantity
FROM lineitem GROUP BY 1""")
def period_quarter(spark, d):
    return T.period_aggregate(table(spark, d, "lineitem"), "l_shipdate", "quarter", "l_quantity", "count")


@query("period_year", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS count FROM orders GROUP BY 1""")
def period_year(spark, d):
    return T.period_aggregate(table(spark, d, "orders"), "o_orderdate", "year")


@query("date_columns", """
SELECT 'o_orderdate' AS "column", 'date' AS kind, 1.0 AS parse_rate
UNION ALL
SELECT 'd_text', 'text', count(try_strptime(d_text, '%Y-%m-%d')) / count(d_text)
FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d_text FROM orders)""")
def date_columns_q(spark, d):
    o = table(spark, d, "orders").withColumn("d_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return T.date_columns(o)


_N = 7


@query("bins_equal", f"""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
e AS (SELECT lo, hi, (hi - lo) / {_N} AS step FROM s)
SELECT o_orderkey, o_totalprice, b AS o_totalprice_bin,
       round(CASE WHEN b = 1 THEN lo - (hi - lo) * 0.001 ELSE lo + step * (b - 1) END, 4) AS o_totalprice_bin_lo,
       round(CASE WHEN b = {_N} THEN hi ELSE lo + step * b END, 4) AS o_totalprice_bin_hi
FROM (SELECT o_orderkey, o_totalprice, lo, hi, step,
             CAST(1 + ({' + '.join(f'(o_totalprice > lo + step * {i})::INT' for i in range(1, _N))}) AS INTEGER) AS b
      FROM orders, e)""")
def bins_equal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = B.equal_width_bins(o, "o_totalprice", _N)
    return out.withColumn("o_totalprice_bin_lo", F.round("o_totalprice_bin_lo", 4)).withColumn(
        "o_totalprice_bin_hi", F.round("o_totalprice_bin_hi", 4))


@query("bins_quantile", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
                  quantile_cont(o_totalprice, 0.75) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi
           FROM orders)
SELECT o_orderkey, o_totalprice,
       CAST(1 + (o_totalprice > a)::INT + (o_totalprice > b)::INT + (o_totalprice > c)::INT AS INTEGER)
         AS o_totalprice_qbin,
       round(CASE WHEN o_totalprice <= a THEN lo WHEN o_totalprice <= b THEN a WHEN o_totalprice <= c THEN b
             ELSE c END, 4) AS o_totalprice_qbin_lo,
       round(CASE WHEN o_totalprice <= a THEN a WHEN o_totalprice <= b THEN b WHEN o_totalprice <= c THEN c
             ELSE hi END, 4) AS o_totalprice_qbin_hi
FROM orders, q""")
def bins_quantile(spark, d):
    out = B.quantile_bins(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 4)
    return out.withColumn("o_totalprice_qbin_lo", F.round("o_totalprice_qbin_lo", 4)).withColumn(
        "o_totalprice_qbin_hi", F.round("o_totalprice_qbin_hi", 4))


@query("bins_quantile_constant", """
SELECT o_orderkey, 1.5::DOUBLE AS flat, NULL::DOUBLE AS gone, NULL::INTEGER AS flat_qbin, NULL::DOUBLE AS flat_qbin_lo,
       NULL::DOUBLE AS flat_qbin_hi, NULL::INTEGER AS gone_qbin, NULL::DOUBLE AS gone_qbin_lo,
       NULL::DOUBLE AS gone_qbin_hi FROM orders""")
def bins_quantile_constant(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey").isNotNull(), 1.5).alias("flat"),
                                         F.lit(None).cast("double").alias("gone"))
    return B.quantile_bins(B.quantile_bins(o, "flat", 4), "gone", 4)


@query("bins_custom", """
SELECT p_partkey, p_retailprice,
       CASE WHEN p_retailprice < 900 OR p_retailprice > 1500 THEN NULL
            WHEN p_retailprice <= 1000 THEN 'low' WHEN p_retailprice <= 1200 THEN 'mid' ELSE 'high' END AS price_band
FROM part""")
def bins_custom(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return B.custom_bins(p, "p_retailprice", [900, 1000, 1200, 1500], labels=["low", "mid", "high"],
                         name="price_band")


_IQR = """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem)"""


@query("outliers_iqr", _IQR + """
SELECT l.* FROM lineitem l, q WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)""")
def outliers_iqr(spark, d):
    return U.outliers(table(spark, d, "lineitem"), "l_extendedprice", "iqr", keep="only")


@query("outliers_iqr_tight", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o.* FROM orders o, q WHERE NOT (o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1))""")
def outliers_iqr_tight(spark, d):
    return U.outliers(table(spark, d, "orders"), "o_totalprice", "iqr", keep="remove", k=0.5)


@query("outliers_z", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT e.* FROM events e, s WHERE sd > 0 AND abs(value - m) > 2 * sd""")
def outliers_z(spark, d):
    return U.outliers(table(spark, d, "events"), "value", "zscore", threshold=2.0)


@query("outliers_bounds", "SELECT * FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48")
def outliers_bounds(spark, d):
    return U.outliers(table(spark, d, "lineitem"), "l_quantity", "bounds", lower=3, upper=48)


@query("outlier_flags", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, o_totalprice, coalesce(sd > 0 AND abs(o_totalprice - m) > 1.5 * sd, false) AS o_totalprice_outlier
FROM orders, s""")
def outlier_flags(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return U.flag_outliers(o, "o_totalprice", "zscore", threshold=1.5)


@query("outlier_summary", _IQR + """
SELECT count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1))
         AS outliers, count(*) AS rows,
       round(100.0 * count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1)
             OR l_extendedprice > q3 + 1.5 * (q3 - q1)) / count(*), 2) AS pct
FROM lineitem, q""")
def outlier_summary(spark, d):
    return U.outlier_summary(table(spark, d, "lineitem"), "l_extendedprice", "iqr")
