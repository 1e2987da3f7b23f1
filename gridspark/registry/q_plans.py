"""Saved views, SQL, sources/sinks and streaming queries (V1, Z1-Z2,
S1-S8, 2.14)."""

from pyspark.sql import functions as F

from gridspark.operators.derive import transform_column
from gridspark.operators.filter import filter_rows
from gridspark.plans.sql import run_sql
from gridspark.plans.views import apply_view, view_from_json, view_to_json
from gridspark.sources.edits import edit_table
from gridspark.registry.base import query, table
from gridspark.session import scratch_path as _scratch
from gridspark.sources import io as S
from gridspark.streaming import stream as ST

_VIEW = {
    "name": "open big lines",
    "filters": [{"column": "l_linestatus", "op": "==", "value": "O"},
                {"column": "l_quantity", "op": ">=", "value": 30},
                {"column": "l_gone", "op": "==", "value": 1}],
    "sort": [{"column": "l_extendedprice", "ascending": False}, {"column": "l_orderkey", "ascending": True},
             {"column": "l_linenumber", "ascending": True}, {"column": "l_partkey", "ascending": True},
             {"column": "l_gone", "ascending": True}],
    "columns": ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"],
    "page": 2, "page_size": 50,
}


@query("apply_view", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem
WHERE l_linestatus = 'O' AND l_quantity >= 30
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50 OFFSET 50""")
def apply_view_q(spark, d):
    spec = view_from_json(view_to_json(_VIEW))
    return apply_view(table(spark, d, "lineitem"), spec)


_SQL = """
SELECT n.n_name, c.c_mktsegment, count(*) AS orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus <> 'P'
GROUP BY n.n_name, c.c_mktsegment"""


@query("sql_passthrough", _SQL)
def sql_passthrough_q(spark, d):
    tabs = {t: table(spark, d, t) for t in ("orders", "customer", "nation")}
    return run_sql(spark, _SQL, tables=tabs)


# The query shapes the tool documents, over the current table ``df``
_Z2 = {
    "sql_select_star": "SELECT * FROM df",
    "sql_where": "SELECT * FROM df WHERE o_totalprice > 300000",
    "sql_group_count": "SELECT o_orderstatus, count(*) AS n FROM df GROUP BY o_orderstatus",
    "sql_avg": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price FROM df GROUP BY o_orderpriority",
    "sql_order_limit": "SELECT * FROM df ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_distinct": "SELECT DISTINCT o_orderpriority FROM df",
}


def _z2(key, q):
    @query(key, q.replace("FROM df", "FROM orders"))
    def run(spark, d):
        return run_sql(spark, q, current=table(spark, d, "orders"))
    return run


for _k, _q in _Z2.items():
    _z2(_k, _q)


@query("sql_window", """
SELECT o_custkey, o_orderkey, o_totalprice,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
FROM orders""")
def sql_window_q(spark, d):
    q = """SELECT o_custkey, o_orderkey, o_totalprice,
       sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM df"""
    out = run_sql(spark, q, current=table(spark, d, "orders"))
    return out.withColumn("running", F.round("running", 2))


@query("csv_roundtrip", "SELECT * FROM supplier")
def csv_roundtrip_q(spark, d):
    path = _scratch(spark, "csv")
    S.write_csv(table(spark, d, "supplier"), path, sep=";")
    back = S.read_csv(spark, path)  # delimiter sniffed from the header line
    return back.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"),
                       F.col("s_acctbal").cast("double"))


@query("parquet_roundtrip", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
def parquet_roundtrip_q(spark, d):
    path = _scratch(spark, "pq")
    S.write_table(table(spark, d, "orders"), path, mode="replace", partition_by=["o_orderstatus"])
    back = S.load_table(spark, path)
    # partition pruning: only the o_orderstatus=O folder is scanned
    return back.where("o_orderstatus = 'O'").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("export_rows", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def export_rows_q(spark, d):
    path = _scratch(spark, "export")
    S.export_rows(table(spark, d, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey"), path, n=100)
    back = S.read_csv(spark, path)
    return back.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"),
                       F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("stream_period_counts", """
SELECT date_trunc('day', ts) AS period, event_type, count(*) AS count, round(sum(value), 4) AS sum_value
FROM events GROUP BY 1, 2""")
def stream_period_counts_q(spark, d):
    ev = table(spark, d, "events")
    sdf = ST.read_stream(spark, d, ev.schema, glob="events.parquet")
    agg = ST.period_counts(sdf, "ts", "1 day", "1 hour", by=["event_type"], value="value")
    out = ST.run_to_table(agg, "complete")
    return out.withColumn("sum_value", F.round("sum_value", 4))


@query("stream_lookup", """
SELECT e.event_id, e.user_id, c.c_name, c.c_mktsegment FROM events e
LEFT JOIN customer c ON e.user_id = c.c_custkey""")
def stream_lookup_q(spark, d):
    ev = table(spark, d, "events")
    sdf = ST.read_stream(spark, d, ev.schema, glob="events.parquet").select("event_id", "user_id")
    joined = ST.lookup_stream(sdf, table(spark, d, "customer"), "user_id", "c_custkey",
                              ["c_name", "c_mktsegment"], order_by=["c_custkey"])
    return ST.run_to_table(joined, "append")


@query("stream_dedupe", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type FROM events")
def stream_dedupe_q(spark, d):
    ev = table(spark, d, "events")
    sdf = ST.read_stream(spark, d, ev.schema, glob="events.parquet")
    dd = ST.dedupe_stream(sdf, ["user_id", "event_type"], "ts", "1000 days")
    return ST.run_to_table(dd.select("user_id", "event_type"), "append")


@query("export_all_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def export_all_rows(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    back = S.export_rows(li, _scratch(spark, "export"), n=None)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in li.schema.fields])


@query("apply_view_deep", """
SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linestatus = 'O'
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 20 OFFSET 2000""")
def apply_view_deep(spark, d):
    return apply_view(table(spark, d, "lineitem"), {
        "name": "deep", "filters": [{"column": "l_linestatus", "op": "==", "value": "O"}],
        "sort": [{"column": "l_extendedprice", "ascending": False},
                 *({"column": c, "ascending": True} for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                              "l_quantity"))],
        "columns": ["l_orderkey", "l_quantity"], "page": 101, "page_size": 20})


@query("table_schema", """
SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name AS "column",
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type, true AS nullable
FROM (SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'orders' ORDER BY ordinal_position)""")
def table_schema_q(spark, d):
    return S.table_schema(table(spark, d, "orders"))


@query("table_list", """
SELECT t AS name, true AS found, n AS rows FROM (
  SELECT 'gs_orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'gs_part', count(*) FROM part)""")
def table_list_q(spark, d):
    names = {"gs_orders": "orders", "gs_part": "part"}
    for view, name in names.items():
        table(spark, d, name).createOrReplaceTempView(view)
    listed = S.list_tables(spark).where(F.col("name").isin(*names)).select("name")
    counts = None
    for view in names:
        one = S.row_count(S.load_table(spark, view)).select(F.lit(view).alias("view"), "rows", F.lit(
            S.table_exists(spark, view)).alias("found"))
        counts = one if counts is None else counts.unionByName(one)
    return listed.join(counts, F.col("name") == F.col("view")).select("name", "found", "rows")


@query("create_table", "SELECT o_orderkey, NULL::VARCHAR AS note, NULL::DOUBLE AS score FROM orders")
def create_table_q(spark, d):
    empty = S.create_table(spark, [("o_orderkey", "int"), ("note", "str"), ("score", "float")])
    return empty.unionByName(table(spark, d, "orders").select("o_orderkey"), allowMissingColumns=True)


@query("stream_row_local", """
SELECT event_id, upper(event_type) AS event_type, value * 2 AS twice FROM events WHERE value > 50""")
def stream_row_local(spark, d):
    ev = table(spark, d, "events")
    sdf = ST.read_stream(spark, d, ev.schema, glob="events.parquet")
    out = transform_column(filter_rows(sdf, "value", ">", 50), "event_type", ["upper"]).withColumn(
        "twice", F.col("value") * 2)
    return ST.run_to_table(out.select("event_id", "event_type", "twice"), "append")


def _event_files(spark, d, n=4):
    """The events as several files, so that a stream takes several batches."""
    ev = table(spark, d, "events")
    path = _scratch(spark, "events")
    ev.repartition(n, "event_id").write.parquet(path)
    return ST.read_stream(spark, path, ev.schema, max_files_per_trigger=1)


@query("stream_update_counts", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_update_counts(spark, d):
    agg = _event_files(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    return ST.run_to_table(agg, "update", keys=["event_type"])


@query("stream_lookup_duplicates", """
SELECT e.event_id, c.c_custkey, c.seg FROM events e LEFT JOIN (
  SELECT c_nationkey, c_custkey, seg FROM (
    SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS seg,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer)
  WHERE rn = 1) c ON e.user_id % 25 = c.c_nationkey""")
def stream_lookup_duplicates(spark, d):
    sdf = _event_files(spark, d).select("event_id", (F.col("user_id") % 25).alias("k"))
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", (-F.col("c_acctbal")).alias("low"),
                                           F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("seg"))
    out = ST.lookup_stream(sdf, c, "k", "c_nationkey", ["c_custkey", "seg"], order_by=["low", "c_custkey"])
    return ST.run_to_table(out.select("event_id", "c_custkey", "seg"), "append")


# edits of two priorities rewrite two of five partitions; the row keeps the number rewritten
@query("edit_table_partitions", """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 AND o_orderpriority IN ('1-URGENT', '5-LOW')
       THEN -1.0 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority,
       (SELECT count(DISTINCT o_orderpriority) FROM orders
        WHERE o_orderkey % 5 = 0 AND o_orderpriority IN ('1-URGENT', '5-LOW')) AS rewritten FROM orders""")
def edit_table_partitions_q(spark, d):
    orders, path = table(spark, d, "orders"), _scratch(spark, "edit")
    S.write_table(orders, path, partition_by=["o_orderpriority"])
    edits = orders.where("o_orderkey % 5 = 0 and o_orderpriority in ('1-URGENT', '5-LOW')").select(
        "o_orderkey", F.lit(-1.0).alias("o_totalprice"))
    n = edit_table(spark, path, edits, "o_orderkey", ["o_orderpriority"])
    return S.load_table(spark, path).select(*orders.columns, F.lit(n).cast("long").alias("rewritten"))


@query("read_sql_orders", """
SELECT o_orderstatus, count(*) AS orders, max(o_orderdate) AS latest FROM orders WHERE o_totalprice > 1000 GROUP BY 1""")
def read_sql_orders_q(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return S.read_sql(spark, "SELECT o_orderstatus, count(1) AS orders, max(o_orderdate) AS latest FROM orders "
                             "WHERE NOT o_totalprice <= 1000 GROUP BY o_orderstatus")
