from pyspark.sql import functions as F

from gridspark.operators.derive import formula
from gridspark.operators.filter import filter_rows
from gridspark.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def _events(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return ST.read_stream(spark, SF, schema, glob="events.parquet")


def test_row_local_operators_accept_streams(spark):
    sdf = _events(spark)
    assert sdf.isStreaming
    out = formula(filter_rows(sdf, "event_type", "==", "click"), "v2", "value * 2")
    res = ST.run_to_table(out.select("event_id", "v2"), "append")
    batch = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'")
    assert res.count() == batch.count()


def test_windowed_counts_match_batch(spark):
    agg = ST.period_counts(_events(spark), "ts", "1 day", "1 hour", by=["event_type"])
    res = ST.run_to_table(agg, "complete")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period"), "event_type").count()
    assert res.select("period", "event_type", "count").exceptAll(batch).count() == 0
    assert res.count() == batch.count()


def test_dedupe_within_watermark(spark):
    dd = ST.dedupe_stream(_events(spark), ["user_id"], "ts", "1000 days")
    res = ST.run_to_table(dd.select("user_id"), "append")
    assert res.count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    out = str(tmp_path / "data")
    write = ST.batch_writer(out)
    one, two = spark.range(3), spark.range(3, 5)
    for batch, n in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, n)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sdf = ST.read_stream(spark, str(tmp_path / "in"), "a long, b string")
    assert ST.run_to_table(sdf, "append").count() == 0
    import pytest
    with pytest.raises(ValueError):
        ST.run_to_table(sdf, "update")
