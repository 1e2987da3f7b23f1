"""Search and diff queries (Q1-Q3, G1)."""


from pyspark.sql import functions as F

from gridspark.operators.checksums import checksums, diff_by_checksum
from gridspark.operators.diff import diff_summary, table_diff
from gridspark.operators.fuzzy import filter_fuzzy_table, fuzzy_join_table, fuzzy_replace_from
from gridspark.operators.search import fuzzy_replace, fuzzy_search, search_all, suggest_values
from gridspark.plans.ordered import materialize
from gridspark.registry.base import query, table


@query("search_all", """
SELECT * FROM customer WHERE contains(lower(CAST(c_custkey AS VARCHAR)), '77')
   OR contains(lower(c_name), '77') OR contains(lower(CAST(c_nationkey AS VARCHAR)), '77')
   OR contains(lower(CAST(c_acctbal AS VARCHAR)), '77') OR contains(lower(c_mktsegment), '77')""")
def search_all_q(spark, d):
    return search_all(table(spark, d, "customer"), "77")


@query("search_text", """
SELECT * FROM part WHERE contains(lower(p_name), 'gear') OR contains(lower(p_brand), 'gear')
   OR contains(lower(p_type), 'gear')""")
def search_text_q(spark, d):
    return search_all(table(spark, d, "part"), "GEAR", columns=["p_name", "p_brand", "p_type"])


_SCORE = "100.0 * (1 - levenshtein(lower(v), '{q}') / greatest(length(v), {n}))"


@query("fuzzy_search", f"""
SELECT value, score, count FROM (
  SELECT v AS value, {_SCORE.format(q='red rign', n=8)} AS score, n AS count
  FROM (SELECT p_name AS v, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1))
ORDER BY score DESC, value LIMIT 10""")
def fuzzy_search_q(spark, d):
    return fuzzy_search(table(spark, d, "part"), "p_name", "red rign")


_CHOICES = ["economy", "standard", "promo", "large", "small", "medium"]


def _suggest_sql():
    arms = " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS choice" for i, c in enumerate(_CHOICES))
    return f"""
WITH v AS (SELECT p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY 1),
c AS ({arms}),
s AS (SELECT value, count, choice, pos,
             100.0 * (1 - levenshtein(lower(value), lower(choice)) / greatest(length(value), length(choice))) AS score
      FROM v, c),
b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, pos) AS rn FROM s)
SELECT value, CASE WHEN score >= 60 THEN choice END AS match, score, count FROM b WHERE rn = 1"""


@query("fuzzy_match_list", _suggest_sql())
def fuzzy_match_list_q(spark, d):
    return suggest_values(table(spark, d, "part"), "p_type", _CHOICES, threshold=60)


@query("fuzzy_replace", f"""
WITH m AS ({_suggest_sql()})
SELECT p.p_partkey, p.p_name, p.p_brand, coalesce(m.match, p.p_type) AS p_type, p.p_size, p.p_retailprice
FROM part p LEFT JOIN m ON p.p_type = m.value""")
def fuzzy_replace_q(spark, d):
    return fuzzy_replace(table(spark, d, "part"), "p_type", _CHOICES, threshold=60)


# after = orders with status-P prices changed, 5-LOW open orders removed, and
# a shifted copy of the urgent orders added under new keys
_AFTER_SPARK = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders
WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')
UNION ALL
SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderpriority = '1-URGENT'"""


def _after(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_AFTER_SPARK)


_TABLE_DIFF = f"""
WITH a AS ({_AFTER_SPARK}),
j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_orderkey IS NOT NULL AS in_b,
             a.o_orderkey IS NOT NULL AS in_a,
             (b.o_custkey IS DISTINCT FROM a.o_custkey)::INT + (b.o_orderstatus IS DISTINCT FROM a.o_orderstatus)::INT
             + (b.o_totalprice IS DISTINCT FROM a.o_totalprice)::INT + (b.o_orderdate IS DISTINCT FROM a.o_orderdate)::INT
             + (b.o_orderpriority IS DISTINCT FROM a.o_orderpriority)::INT AS n,
             b.o_totalprice IS DISTINCT FROM a.o_totalprice AS price_changed
      FROM orders b FULL OUTER JOIN a ON b.o_orderkey = a.o_orderkey)
SELECT o_orderkey,
       CASE WHEN NOT in_b THEN 'added' WHEN NOT in_a THEN 'removed' WHEN n > 0 THEN 'changed' ELSE 'same' END AS status,
       CAST(CASE WHEN in_a AND in_b THEN n ELSE 5 END AS BIGINT) AS changed_cells,
       CASE WHEN in_a AND in_b THEN 'o_totalprice'
            ELSE 'o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' END AS changed_columns
FROM j WHERE NOT (in_a AND in_b AND n = 0)"""


@query("diff_by_checksum", _TABLE_DIFF)
def diff_by_checksum_q(spark, d):
    return diff_by_checksum(table(spark, d, "orders"), _after(spark, d), "o_orderkey")


# the same diff against stored checksums of the first version
@query("diff_by_stored_checksum", _TABLE_DIFF)
def diff_by_stored_checksum_q(spark, d):
    before = table(spark, d, "orders")
    stored = materialize(checksums(before, "o_orderkey", bits=12), "checksums")
    return diff_by_checksum(before, _after(spark, d), "o_orderkey", bits=12, before_checksums=stored)


@query("table_diff", _TABLE_DIFF)
def table_diff_q(spark, d):
    return table_diff(table(spark, d, "orders"), _after(spark, d), "o_orderkey")


@query("diff_summary", f"""
WITH a AS ({_AFTER_SPARK}),
j AS (SELECT b.o_orderkey IS NOT NULL AS in_b, a.o_orderkey IS NOT NULL AS in_a,
             (b.o_totalprice IS DISTINCT FROM a.o_totalprice)::INT AS n
      FROM orders b FULL OUTER JOIN a ON b.o_orderkey = a.o_orderkey)
SELECT count(*) FILTER (WHERE in_b) AS rows_before, count(*) FILTER (WHERE in_a) AS rows_after,
       count(*) FILTER (WHERE NOT in_b) AS added, count(*) FILTER (WHERE NOT in_a) AS removed,
       count(*) FILTER (WHERE in_a AND in_b AND n > 0) AS changed,
       CAST(coalesce(sum(n) FILTER (WHERE in_a AND in_b AND n > 0), 0) AS BIGINT) AS changed_cells FROM j""")
def diff_summary_q(spark, d):
    return diff_summary(table(spark, d, "orders"), _after(spark, d), "o_orderkey")


@query("pages_search", """
SELECT * FROM pages WHERE contains(lower(CAST(page_id AS VARCHAR)), '/fr/')
   OR contains(lower(url), '/fr/') OR contains(lower(html), '/fr/')""")
def pages_search(spark, d):
    return search_all(table(spark, d, "pages"), "/FR/")


@query("conversations_text_search", """
SELECT conv_id, turn, role FROM conversations
WHERE contains(lower(text), 'the') AND role = 'assistant'""")
def conversations_text_search(spark, d):
    from gridspark.operators.filter import filter_rows
    c = filter_rows(table(spark, d, "conversations"), "role", "==", "assistant")
    return search_all(c, "the", columns=["text"]).select("conv_id", "turn", "role")


@query("diff_null_key", """
WITH b AS (SELECT nullif(c_custkey, (SELECT min(c_custkey) FROM customer)) AS k FROM customer)
SELECT k, 'changed' AS status, 1::BIGINT AS changed_cells, 'c_nationkey' AS changed_columns FROM b
WHERE k IS NULL OR k % 2 = 0""")
def diff_null_key(spark, d):
    c = table(spark, d, "customer")
    least = c.select(F.min("c_custkey")).scalar()
    b = c.select(F.nullif(F.col("c_custkey"), least).alias("k"), "c_name", "c_nationkey")
    a = b.withColumn("c_nationkey", F.when(F.col("k").isNull() | (F.col("k") % 2 == 0), F.col("c_nationkey") + 100)
                     .otherwise(F.col("c_nationkey")))
    return table_diff(b, a, "k")


_LABEL = "p_name || ' ' || p_brand || ' ' || p_type"
#: Each distinct label with its closest reference label (a misspelt list), by all pairs.
_FUZZY_TABLE = f"""
WITH v AS (SELECT {_LABEL} AS value, count(*) AS count FROM part GROUP BY 1),
r AS (SELECT DISTINCT replace(replace({_LABEL}, 'i', 'y'), 'Brand#', 'Brnd ') AS ref FROM part WHERE p_size > 25),
s AS (SELECT value, count, ref,
             100.0 * (1 - levenshtein(lower(value), lower(ref)) / greatest(length(value), length(ref))) AS score FROM v, r),
b AS (SELECT * FROM s WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY value ORDER BY score DESC, ref) = 1),
m AS (SELECT v.value, b.ref AS match, b.score, v.count FROM v LEFT JOIN b ON b.value = v.value)"""


def _labels(spark, d):
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    part = table(spark, d, "part").withColumn("label", label)
    misspelt = F.replace(F.replace("label", F.lit("i"), F.lit("y")), F.lit("Brand#"), F.lit("Brnd "))
    return part, part.where("p_size > 25").select(misspelt.alias("ref"))


@query("fuzzy_join_table", f"{_FUZZY_TABLE} SELECT value, match, score, count FROM m")
def fuzzy_join_table_q(spark, d):
    part, refs = _labels(spark, d)
    return fuzzy_join_table(part, "label", refs, "ref", 85)


@query("fuzzy_replace_table", f"""{_FUZZY_TABLE}
SELECT p_partkey, coalesce(match, value) AS label FROM part JOIN m ON m.value = {_LABEL}""")
def fuzzy_replace_table_q(spark, d):
    part, refs = _labels(spark, d)
    return fuzzy_replace_from(part.select("p_partkey", "label"), "label", refs, "ref", 85)


@query("filter_fuzzy_table", f"""{_FUZZY_TABLE}
SELECT part.* FROM part JOIN m ON m.value = {_LABEL} WHERE match IS NOT NULL""")
def filter_fuzzy_table_q(spark, d):
    part, refs = _labels(spark, d)
    return filter_fuzzy_table(part, "label", refs, "ref", 85).drop("label")
