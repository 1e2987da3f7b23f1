"""Structured Streaming forms of the row-local and time-grouped operators.

Row-local operators (filters, projections, derived columns, casts, find &
replace, search) accept a streaming DataFrame unchanged. The helpers here
cover the stateful ones: calendar grouping with a watermark, stream-static
lookups and de-duplication within the watermark.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.ordered import order_key
from gridspark.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A file folder as a stream (explicit schema, as streams require);
    ``glob`` limits it to matching file names."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def event_time(c):
    """A zoned timestamp for watermarks from a wall-clock ``timestamp_ntz``
    column, independent of the session time zone (its UTC rendering is the
    wall clock, so day windows align with calendar days)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(c)))


def wall_clock(c):
    """Inverse of ``event_time``: back to ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch())


def period_counts(sdf: DataFrame, ts: str, period: str = "1 day", watermark: str = "1 hour",
                  by: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """T1 on a stream: per event-time window (and ``by`` keys) the row count
    and, with ``value``, its sum; late rows beyond ``watermark`` are
    dropped and their state released."""
    aggs = [F.count(F.lit(1)).alias("count")]
    if value:
        aggs.append(F.sum(value).alias(f"sum_{value}"))
    # watermarks need a zoned timestamp
    timed = sdf.withColumn("__et", event_time(ts))
    return (timed.withWatermark("__et", watermark)
            .groupBy(F.window("__et", period).alias("w"), *by).agg(*aggs)
            .select(wall_clock(F.col("w.start")).alias("period"), *by,
                    *[a for a in ["count"] + ([f"sum_{value}"] if value else [])]))


def lookup_stream(sdf: DataFrame, static: DataFrame, stream_key: str, static_key: str,
                  columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """J9 on a stream: left join against a static table reduced to one row
    per key, the first in ``order_by`` order (nulls last)."""
    if not order_by:
        raise ValueError("stream lookups need order_by")
    red = static.where(F.col(static_key).isNotNull()).groupBy(F.col(static_key).alias("__k")).agg(
        F.min_by(F.struct(*columns), order_key(order_by)).alias("__row"))
    red = red.select("__k", *[F.col("__row")[c].alias(c) for c in columns])
    return sdf.join(red, sdf[stream_key] == red["__k"], "left").drop("__k")


def dedupe_stream(sdf: DataFrame, keys: Sequence[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """C8 on a stream: drop repeats of ``keys`` seen within the watermark."""
    timed = sdf.withColumn("__et", event_time(ts))
    return timed.withWatermark("__et", watermark).dropDuplicatesWithinWatermark(list(keys)).drop("__et")


def run_to_table(sdf: DataFrame, output_mode: str = "complete", path: str | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Run a streaming query over everything available now and return its
    result table.

    Each micro-batch overwrites a folder of its own under the shared checkpoint
    folder (``spark.checkpoint.dir``), so a replayed batch is not written twice.
    The result is the last batch in complete mode, all batches in append mode,
    and in update mode the latest row of each of ``keys`` (required there)."""
    spark = sdf.sparkSession
    if output_mode == "update" and not keys:
        raise ValueError("update mode needs the keys of the result table")
    base = path or scratch_path(spark, "stream")
    out, ckpt = f"{base}/data", f"{base}/_checkpoint"

    q = (sdf.writeStream.outputMode(output_mode).foreachBatch(batch_writer(out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], sdf.schema)
    rows = spark.read.option("basePath", out).parquet(out)
    if output_mode == "complete":
        last = rows.select(F.max("__batch")).scalar()
        rows = rows.where(F.col("__batch") == last)
    elif output_mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*sdf.columns), "__batch").alias("__row")).select("__row.*")
    return rows.select(*sdf.columns)


def batch_writer(out: str):
    """A ``foreachBatch`` function that keeps each batch in its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/__batch={batch_id}")
    return write
