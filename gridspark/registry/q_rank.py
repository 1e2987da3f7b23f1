"""Ranking queries."""

from gridspark.operators.rank import category_codes, rank, ranks, top_n_ranked, top_percent
from gridspark.registry.base import query, table

_O = "o_orderkey, o_custkey, o_totalprice"


@query("rank_min_bucketed", f"""
SELECT {_O}, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS o_totalprice_rank
FROM orders""")
def rank_min_bucketed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rank(o, "o_totalprice", "min", group="o_custkey", strategy="positions")


@query("rank_avg_bucketed", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
       (rank() OVER w + count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0
         AS l_quantity_rank
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def rank_avg_bucketed(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rank(li, "l_quantity", "average", group="l_returnflag", ascending=True, strategy="positions")


@query("rank_pct_bucketed", """
SELECT c_custkey, c_mktsegment, c_acctbal,
       round((rank() OVER w + count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0
             / count(*) OVER (PARTITION BY c_mktsegment), 9) AS c_acctbal_rank
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)""")
def rank_pct_bucketed(spark, d):
    from pyspark.sql import functions as F
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    r = rank(c, "c_acctbal", "percentile", group="c_mktsegment", strategy="positions")
    return r.withColumn("c_acctbal_rank", F.round("c_acctbal_rank", 9))


@query("rank_first_bucketed", """
SELECT p_partkey, p_brand, p_size,
       row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS p_size_rank
FROM part""")
def rank_first_bucketed(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return rank(p, "p_size", "first", group="p_brand", tiebreak=["p_partkey"], strategy="positions")


@query("rank_min", f"""
SELECT {_O}, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS o_totalprice_rank
FROM orders""")
def rank_min(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rank(o, "o_totalprice", "min", group="o_custkey")


@query("rank_max", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
       count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC
                      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l_quantity_rank
FROM lineitem""")
def rank_max(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rank(li, "l_quantity", "max", group="l_returnflag")


@query("rank_avg", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
       (rank() OVER w + count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0
         AS l_quantity_rank
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def rank_avg(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rank(li, "l_quantity", "average", group="l_returnflag", ascending=True)


@query("rank_first", """
SELECT p_partkey, p_brand, p_size,
       row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS p_size_rank
FROM part""")
def rank_first(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return rank(p, "p_size", "first", group="p_brand", tiebreak=["p_partkey"])


@query("rank_dense", """
SELECT p_partkey, p_brand, p_size,
       dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS p_size_rank
FROM part""")
def rank_dense(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return rank(p, "p_size", "dense", group="p_brand")


@query("rank_pct", """
SELECT c_custkey, c_mktsegment, c_acctbal,
       round((rank() OVER w + count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0
             / count(*) OVER (PARTITION BY c_mktsegment), 9) AS c_acctbal_rank
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)""")
def rank_pct(spark, d):
    from pyspark.sql import functions as F
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    r = rank(c, "c_acctbal", "percentile", group="c_mktsegment")
    return r.withColumn("c_acctbal_rank", F.round("c_acctbal_rank", 9))


@query("rank_multi", """
SELECT o_orderkey, o_orderpriority, o_totalprice,
       rank() OVER (ORDER BY o_orderpriority ASC, o_totalprice DESC) AS o_orderpriority_rank
FROM orders""")
def rank_multi(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rank(o, ["o_orderpriority", "o_totalprice"], "min", ascending=[True, False])


@query("rank_group_topn", """
SELECT * FROM (
  SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
         rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS p_retailprice_rank
  FROM part) WHERE p_retailprice_rank <= 3""")
def rank_group_topn(spark, d):
    return top_n_ranked(table(spark, d, "part"), "p_retailprice", 3, "min", group="p_brand")


@query("rank_topn_dense_ties", """
SELECT * FROM (
  SELECT *, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS l_quantity_rank
  FROM lineitem) WHERE l_quantity_rank <= 2""")
def rank_topn_dense_ties(spark, d):
    return top_n_ranked(table(spark, d, "lineitem"), "l_quantity", 2, "dense", group="l_returnflag")


@query("rank_topn_first", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)
         AS o_totalprice_rank FROM orders) WHERE o_totalprice_rank <= 5""")
def rank_topn_first(spark, d):
    return top_n_ranked(table(spark, d, "orders"), "o_totalprice", 5, "first", group="o_orderpriority",
                        tiebreak=["o_orderkey"])


@query("rank_top_pct", """
SELECT * FROM (
  SELECT *, (rank() OVER w + count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0
            / count(*) OVER () AS o_totalprice_rank
  FROM orders WINDOW w AS (ORDER BY o_totalprice DESC)) WHERE o_totalprice_rank <= 0.1""")
def rank_top_pct(spark, d):
    return top_percent(table(spark, d, "orders"), "o_totalprice", 10)


@query("rank_global_bucketed", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       rank() OVER (ORDER BY l_extendedprice DESC) AS rank_min,
       dense_rank() OVER (ORDER BY l_extendedprice DESC) AS rank_dense
FROM lineitem""")
def rank_global_bucketed(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks(li, "l_extendedprice", {"rank_min": "min", "rank_dense": "dense"}, strategy="positions")


@query("rank_global_window", """
SELECT l_orderkey, l_linenumber, l_quantity,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS l_quantity_rank
FROM lineitem""")
def rank_global_window(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rank(li, "l_quantity", "min", group="l_returnflag", strategy="window").drop("l_returnflag")


@query("rank_global_plain", """
SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice DESC) AS rank_min,
       dense_rank() OVER (ORDER BY l_extendedprice DESC) AS rank_dense
FROM lineitem""")
def rank_global_plain(spark, d):
    """The data of ``rank_global_bucketed`` through one plain window, for comparison."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks(li, "l_extendedprice", {"rank_min": "min", "rank_dense": "dense"}, strategy="window")


_NULL_PRICE = "CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END"


def _null_ranks(strategy):
    @query(f"rank_null_keys_{strategy}", f"""
SELECT o_orderkey, o_orderstatus, {_NULL_PRICE} AS price,
       CASE WHEN {_NULL_PRICE} IS NOT NULL THEN
            rank() OVER (PARTITION BY o_orderstatus ORDER BY {_NULL_PRICE} DESC NULLS LAST) END AS price_rank
FROM orders""")
    def run(spark, d):
        o = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus", f"{_NULL_PRICE} AS price")
        return rank(o, "price", "min", group="o_orderstatus", strategy=strategy)
    return run


for _s in ("auto", "window", "positions"):
    _null_ranks(_s)


@query("category_codes", """
SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1) AS p_type_code FROM part""")
def category_codes_q(spark, d):
    return category_codes(table(spark, d, "part").select("p_partkey", "p_type"), "p_type")


@query("rank_dense_bucketed", """
SELECT p_partkey, p_brand, p_size,
       dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS p_size_rank
FROM part""")
def rank_dense_bucketed(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return rank(p, "p_size", "dense", group="p_brand", strategy="positions")
