"""Exact most frequent values without a shuffle of all values (D3p, A10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column
from gridspark.functions.names import quoted

BUCKETS = 1 << 16
MAX_BUCKETS = 1 << 18   # their bit set travels in the plan: 32 KB at most
FIRST_LOOK = 8          # buckets counted first, for each value asked for


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("_v"), F.lit(buckets))


def _chosen(numbers: np.ndarray, buckets: int) -> Column:
    """Whether a row's bucket is among ``numbers``: one test of a bit."""
    bits = np.zeros(buckets, dtype=bool)
    bits[numbers] = True
    words = np.packbits(bits, bitorder="little").view("<i8").tolist()
    b = _bucket(buckets)
    word = F.get(F.lit(words), F.call_function("shiftright", b, F.lit(6)).cast("int"))
    bit = F.call_function("shiftright", word, b.bitwiseAND(F.lit(63)).cast("int"))
    return bit.bitwiseAND(F.lit(1)) == 1


def _counts(values: DataFrame) -> DataFrame:
    return values.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))


def bucket_counts(values: DataFrame, buckets: int) -> np.ndarray:
    """Rows of each hash bucket of the column ``_v``: no value of a bucket can be more
    frequent than the bucket. Counts of parts of a table add up to those of the whole."""
    found = values.groupBy(_bucket(buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["b"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def candidates(values: DataFrame, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the buckets that hold every one of the ``k`` most frequent values (and
    all values tied with the last of them), and the rows of all buckets.

    Values of the fullest buckets are counted first; the k-th count among them is a
    lower bound of the k-th count of all, so a bucket with fewer rows holds none of
    the values sought, which is the proof that none is missed."""
    bound = bucket_counts(values, buckets)
    used = np.flatnonzero(bound)
    first = used[np.argsort(-bound[used], kind="stable")][:FIRST_LOOK * k]
    if len(first) == len(used):
        return used, bound
    best = _counts(values.where(_chosen(first, buckets))).orderBy(F.col("_n").desc()).limit(k)
    least, n = best.agg(F.min("_n"), F.count(F.lit(1))).first()
    return (np.flatnonzero(bound >= least) if n == k else used), bound


def top_values_bounded(df: DataFrame, column, k: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """D3p / A10: the ``k`` most frequent non-null values of a column with their exact
    counts: ``value``, ``count``, ``rank`` (from 1; ties by value).

    The same answer as counting all values, in up to three reads of the one column: rows
    per hash bucket (at most ``buckets`` rows reach the shuffle for each task, and the
    driver), an exact count of the fullest buckets for a bound of the k-th count, and
    an exact count of the values in buckets that reach it. Only these values are
    shuffled. With ``n`` rows it saves the more, the further the k-th count lies above
    ``n / buckets``; where no bucket falls below the bound, all values are counted.

    Nulls are left out; 0.0 and -0.0 are one value, NaN is a value; fewer than ``k``
    values give them all; an empty table gives no rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if not 64 <= buckets <= MAX_BUCKETS or buckets % 64:
        raise ValueError(f"buckets must be a multiple of 64 from 64 to {MAX_BUCKETS}")
    name = resolve_column(column, df.columns)
    values = df.select(quoted(name).alias("_v")).where("_v is not null")
    kept, bound = candidates(values, k, buckets)
    if len(kept) < np.count_nonzero(bound):
        values = values.where(_chosen(kept, buckets))
    rank = F.row_number().over(Window.orderBy(F.col("_n").desc(), F.col("_v").asc()))
    best = _counts(values).orderBy(F.col("_n").desc(), F.col("_v").asc()).limit(k)
    return best.select(F.col("_v").alias("value"), F.col("_n").alias("count"), rank.alias("rank"))
