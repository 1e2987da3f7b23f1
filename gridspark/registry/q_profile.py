"""Profiling, issue scan and text analysis queries (D1p-D7p, C19-C20, L1-L3)."""

from pyspark.sql import functions as F

from gridspark.operators import issues as I
from gridspark.operators import profile as P
from gridspark.operators import text as L
from gridspark.operators.heavy import top_values_bounded
from gridspark.registry.base import query, table

# (column, spark simple type, kind) of customer
_CUST = [("c_custkey", "bigint", "number"), ("c_name", "string", "text"),
         ("c_nationkey", "int", "number"), ("c_acctbal", "double", "number"),
         ("c_mktsegment", "string", "text")]


def _semantic_sql(c, kind):
    nonnull = f"count({c})"
    dist = f"count(DISTINCT {c})"
    rules = []
    if kind == "number":
        rules.append(f"WHEN coalesce(bool_and({c} IN (0, 1)), true) THEN 'Flag (0/1)'")
    if kind == "text":
        rules.append(f"WHEN coalesce(bool_and(lower({c}) IN ('yes','no','y','n','true','false')), true) "
                     "THEN 'Flag (Yes/No)'")
    rules.append(f"WHEN {dist} + (count(*) > {nonnull})::INT = count(*) THEN 'ID (Unique)'")
    if kind == "text":
        rules.append(f"WHEN {nonnull} > 0 AND count(*) FILTER (WHERE try_strptime(trim({c}), "
                     f"['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%Y/%m/%d', "
                     f"'%m/%d/%Y %H:%M:%S', '%m/%d/%Y', '%d.%m.%Y']) IS NOT NULL) / {nonnull} > 0.7 "
                     "THEN 'Date-like string'")
        rules.append(f"WHEN coalesce(bool_or(regexp_matches({c}, '^[\\w.-]+@[\\w.-]+\\.\\w+')), false) "
                     "THEN 'Email'")
    rules.append(f"WHEN {dist} <= 10 THEN 'Category (' || CAST({dist} AS VARCHAR) || ' values)'")
    if kind == "text":
        rules.append(f"WHEN {nonnull} > 0 AND count(TRY_CAST({c} AS DOUBLE)) / {nonnull} > 0.8 "
                     "THEN 'Numeric (stored as text)'")
    return "CASE " + " ".join(rules) + " ELSE 'Free Text' END"


def _profile_sql():
    parts = []
    for c, t, kind in _CUST:
        num = kind == "number"
        stats = (f"round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS median, "
                 f"round(stddev_samp({c}), 4) AS std, "
                 f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
                 f"count(*) FILTER (WHERE abs({c} - (SELECT avg({c}) FROM customer)) > "
                 f"3 * (SELECT stddev_samp({c}) FROM customer)) AS outliers_3sd") if num else (
            "NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS min, "
            "NULL::DOUBLE AS max, NULL::BIGINT AS outliers_3sd")
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, "
            f"count(DISTINCT {c}) + (count(*) > count({c}))::BIGINT AS distinct, "
            f"{_semantic_sql(c, kind)} AS semantic_type, {stats} FROM customer")
    return "\nUNION ALL ".join(parts)


@query("profile", _profile_sql())
def profile_q(spark, d):
    out = P.profile(table(spark, d, "customer"))
    return out.select(*[F.round(c, 4).alias(c) if c in ("mean", "median", "std") else F.col(c)
                        for c in out.columns])


@query("detect_types", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_semantic_sql(c, k)} AS semantic_type FROM orders"
    for c, k in [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"),
                 ("o_totalprice", "number"), ("o_orderpriority", "text")])
    + "\nUNION ALL SELECT 'o_orderdate', 'Date'")
def detect_types_q(spark, d):
    return P.detect_types(table(spark, d, "orders"))


@query("top_values", """
WITH u AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
           UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
           UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT "column", value, count(*) AS count FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER)
               AS rank FROM c) WHERE rank <= 5""")
def top_values_q(spark, d):
    return P.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], k=5)


def _bounded_sql(table_name, column, k):
    return f"""
SELECT {column} AS value, count(*) AS count,
       CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) AS INTEGER) AS rank
FROM {table_name} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY rank LIMIT {k}"""


@query("top_values_bounded", _bounded_sql("lineitem", "l_extendedprice", 10))
def top_values_bounded_q(spark, d):
    return top_values_bounded(table(spark, d, "lineitem"), "l_extendedprice", k=10)


@query("top_values_bounded_text", _bounded_sql("events", "props", 25))
def top_values_bounded_text(spark, d):
    return top_values_bounded(table(spark, d, "events"), "props", k=25)


@query("top_values_copied_texts", _bounded_sql("documents", "text", 20))
def top_values_copied_texts(spark, d):
    """The most copied texts, whole."""
    return top_values_bounded(table(spark, d, "documents"), "text", k=20)


_PRIO_NULL = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN '  ' ELSE o_orderpriority END"
_PRICE_NULL = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END"


@query("null_report", f"""
WITH t AS (SELECT o_orderkey, {_PRIO_NULL} AS prio, {_PRICE_NULL} AS price,
                  CAST(NULL AS VARCHAR) AS empty FROM orders),
s AS (
  SELECT 0 AS pos, 'o_orderkey' AS "column", 'bigint' AS type, count(*) - count(o_orderkey) AS nulls,
         count(*) AS n, 0 AS blanks FROM t
  UNION ALL SELECT 1, 'prio', 'string', count(*) - count(prio), count(*),
         count(*) FILTER (WHERE prio IS NOT NULL AND trim(prio) = '') FROM t
  UNION ALL SELECT 2, 'price', 'double', count(*) - count(price), count(*), 0 FROM t
  UNION ALL SELECT 3, 'empty', 'string', count(*) - count(empty), count(*), 0 FROM t)
SELECT "column", type, nulls, round(100.0 * nulls / n, 2) AS null_pct, CAST(blanks AS BIGINT) AS blanks,
       CASE WHEN nulls = 0 AND blanks = 0 THEN 'Clean' WHEN nulls = n THEN 'All Empty'
            WHEN 100.0 * nulls / n > 50 THEN 'High Missing' WHEN 100.0 * nulls / n > 10 THEN 'Some Missing'
            ELSE 'Minor' END AS status
FROM s""")
def null_report_q(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.expr(_PRIO_NULL).alias("prio"), F.expr(_PRICE_NULL).alias("price"),
        F.lit(None).cast("string").alias("empty"))
    return P.missing_report(o)


@query("missing_total", f"""
WITH t AS (SELECT o_orderkey, {_PRIO_NULL} AS prio, {_PRICE_NULL} AS price FROM orders)
SELECT (count(*) - count(prio)) + (count(*) - count(price)) AS missing, count(*) * 3 AS cells,
       round(100.0 * ((count(*) - count(prio)) + (count(*) - count(price))) / (count(*) * 3), 2) AS pct FROM t""")
def missing_total_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_PRIO_NULL).alias("prio"),
                                         F.expr(_PRICE_NULL).alias("price"))
    return P.missing_total(o)


@query("date_ranges", """
SELECT 'o_orderdate' AS "column", min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders
UNION ALL SELECT 'd_text', min(CAST(d_text AS TIMESTAMP)), max(CAST(d_text AS TIMESTAMP))
FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d_text FROM orders)""")
def date_ranges_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate",
                                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("d_text"))
    return P.date_ranges(o)


def _inspect_sql():
    cols = [("A", "c_custkey", "bigint"), ("B", "c_name", "string"), ("C", "c_nationkey", "int"),
            ("D", "c_acctbal", "double"), ("E", "c_mktsegment", "string")]
    parts = []
    for letter, c, t in cols:
        parts.append(f"""
SELECT '{letter}' AS letter, '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS nulls,
       count(DISTINCT {c}) AS distinct,
       (SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (
          SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL
          GROUP BY 1 ORDER BY n DESC, v LIMIT 4)) AS top_values
FROM customer""")
    return "\nUNION ALL".join(parts)


@query("inspect_columns", _inspect_sql())
def inspect_columns_q(spark, d):
    out = P.inspect_columns(table(spark, d, "customer"))
    return out.withColumn("top_values", F.array_join("top_values", "|"))


_ISSUE_COLS_SPARK = {
    "o_orderkey": "o_orderkey",
    "d_text": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "mixed": "CASE WHEN o_orderstatus = 'F' THEN 'abc' ELSE CAST(o_custkey AS STRING) END",
    "big_id": "CAST(o_orderkey AS DOUBLE) + 1e15",
    "sparse": "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'x' END",
    "o_orderstatus": "o_orderstatus",
}


def _issue_table_sql():
    cols = ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in _ISSUE_COLS_SPARK.items())
    return f"(SELECT {cols} FROM orders)"


def _issue_sql():
    t = _issue_table_sql()
    parts = []
    for n in _ISSUE_COLS_SPARK:
        text = n in ("d_text", "mixed", "sparse", "o_orderstatus")
        parts.append(f"SELECT '{n}' AS \"column\", 'high_nulls' AS issue FROM {t} HAVING "
                     f"(count(*) - count({n})) / count(*) >= 0.9")
        parts.append(f"SELECT '{n}', 'unique_values' FROM {t} HAVING "
                     f"count(DISTINCT {n}) + (count(*) > count({n}))::INT = count(*) AND count(*) > 10")
        if n == "big_id":
            parts.append(f"SELECT '{n}', 'float_id_precision' FROM {t} HAVING "
                         f"bool_and(abs({n} - round({n})) < 0.1) AND bool_or(abs({n}) >= 1e15)")
        if text:
            parts.append(f"SELECT '{n}', 'date_like_strings' FROM {t} HAVING count({n}) > 0 AND "
                         f"count(*) FILTER (WHERE try_strptime(trim({n}), '%Y-%m-%d') IS NOT NULL)"
                         f" / count({n}) >= 0.7")
            parts.append(f"SELECT '{n}', 'mixed_types' FROM {t} HAVING "
                         f"coalesce(bool_or(regexp_matches({n}, '^\\d+$')), false)::INT + "
                         f"coalesce(bool_or(regexp_matches({n}, '^(\\d+\\.\\d*|\\.\\d+)$')), false)::INT + "
                         f"coalesce(bool_or(regexp_matches({n}, '\\p{{L}}')), false)::INT >= 2")
    return "\nUNION ALL ".join(parts)


@query("issue_scan", _issue_sql())
def issue_scan_q(spark, d):
    o = table(spark, d, "orders").select(*[F.expr(e).alias(n) for n, e in _ISSUE_COLS_SPARK.items()])
    return I.issue_scan(o)


@query("issue_fix_float_id", """
SELECT o_orderkey, CAST(round_even(CAST(o_orderkey AS DOUBLE) + 1e15, 0) AS BIGINT) AS big_id FROM orders""")
def issue_fix_float_id(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CAST(o_orderkey AS DOUBLE) + 1e15").alias("big_id"))
    return I.apply_fix(o, "big_id", "float_id_precision")


@query("issue_fix_mixed", """
SELECT o_orderkey, regexp_replace(CASE WHEN o_orderstatus = 'F' THEN ' abc ' ELSE CAST(o_custkey AS VARCHAR) END,
                                  '^\\s+|\\s+$', '', 'g') AS mixed FROM orders""")
def issue_fix_mixed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(
        "CASE WHEN o_orderstatus = 'F' THEN ' abc ' ELSE CAST(o_custkey AS STRING) END").alias("mixed"))
    return I.apply_fix(o, "mixed", "mixed_types")


@query("text_lengths", """
SELECT CAST(min(length(text)) AS INTEGER) AS min_len, CAST(max(length(text)) AS INTEGER) AS max_len,
       avg(length(text)) AS mean_len FROM documents""")
def text_lengths_q(spark, d):
    return L.text_lengths(table(spark, d, "documents"), "text")


@query("text_issues", """
SELECT count(text) AS "values", count(*) FILTER (WHERE starts_with(text, ' ')) AS leading_spaces,
       count(*) FILTER (WHERE ends_with(text, ' ')) AS trailing_spaces,
       count(*) FILTER (WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '') AS empty,
       count(DISTINCT text) AS distinct, count(DISTINCT lower(text)) AS distinct_lower,
       count(*) FILTER (WHERE regexp_matches(text, '^-?\\d+\\.?\\d*$')) AS numeric_like,
       count(DISTINCT lower(text)) < count(DISTINCT text) AS case_variants,
       count(*) FILTER (WHERE regexp_matches(text, '^-?\\d+\\.?\\d*$')) > count(text) * 0.5 AS mostly_numeric
FROM documents""")
def text_issues_q(spark, d):
    return L.text_issues(table(spark, d, "documents"), "text")


@query("top_chars", """
SELECT ch AS char, count(*) AS count FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)
WHERE ch <> ' ' AND ch <> '' GROUP BY 1 ORDER BY count DESC, char LIMIT 10""")
def top_chars_q(spark, d):
    return L.top_chars(table(spark, d, "documents"), "text")
