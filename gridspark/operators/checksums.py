"""Diff of two versions of a table by a tree of checksums (G1 for large tables).

Rows are dealt to 2^bits buckets by a hash of their key. A bucket's checksum is
free of order: row count, exclusive-or and sum of row hashes, from one partial
aggregation over each version (or over the new version only, where the old one's
checksums were stored). The upper level of the tree combines 2^(bits / 2) neighbouring
buckets; only buckets below a differing upper one are compared, and only rows of
differing buckets are joined.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_columns
from gridspark.functions.names import free_name, quoted
from gridspark.operators.diff import table_diff

BITS = 16
MOST_BITS = 20     # of a bucket number: the table of differing buckets has 2^20 rows at most


def _hashable(df: DataFrame, column: str) -> list[Column]:
    """A column as values whose hash is equal where ``<=>`` is: null told apart,
    minus zero as zero, maps by their sorted entries."""
    c, dtype = quoted(column), df.schema[column].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(dtype)
    elif isinstance(dtype, T.MapType):
        c = F.to_json(F.array_sort(F.map_entries(c)))
    return [c.isNull(), c]


def bucket_of(df: DataFrame, keys: Sequence[str], bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[x for k in keys for x in _hashable(df, k)]), 64 - bits).cast("int")


def checksums(df: DataFrame, key: Sequence[str] | str, columns: Sequence[str] | None = None,
              bits: int = BITS) -> DataFrame:
    """(bucket, rows, xors, sums): the checksum of every bucket that holds rows. Store it
    with a version of the table to compare later versions without reading this one."""
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be between 1 and {MOST_BITS}")
    keys = resolve_columns([key] if isinstance(key, str) else key, df.columns)
    cols = resolve_columns(columns, df.columns) if columns else [c for c in df.columns if c not in keys]
    parts = [x for c in [*keys, *sorted(cols)] for x in _hashable(df, c)]
    return df.groupBy(bucket_of(df, keys, bits).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*parts)).alias("xors"),
        F.sum(F.xxhash64(F.lit(1), *parts).bitwiseAND(F.lit((1 << 32) - 1)).cast("decimal(38,0)")).alias("sums"))


def differing_buckets(before: DataFrame, after: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket): the buckets in which two tables of ``checksums`` differ, found from the
    upper level down."""
    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        held = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("rows", "xors", "sums")]
        same = held[0] & held[1] & held[2]
        return (a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer")
                .where(~same).select(F.coalesce("a.bucket", "b.bucket").alias("bucket")))

    def upper(df: DataFrame) -> DataFrame:
        return df.groupBy(F.shiftright("bucket", bits // 2).alias("bucket")).agg(
            F.sum("rows").alias("rows"), F.bit_xor("xors").alias("xors"), F.sum("sums").alias("sums"))

    top = differ(upper(before), upper(after)).withColumnRenamed("bucket", "top")
    a, b = (df.join(top, F.shiftright("bucket", bits // 2) == F.col("top"), "left_semi") for df in (before, after))
    return differ(a, b)


def rows_in_buckets(df: DataFrame, keys: Sequence[str], buckets: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` in the listed buckets: a filter before any shuffle. The list has
    at most 2^bits rows of one int (4 MB at ``MOST_BITS``), so it is sent to all tasks."""
    name = free_name(df.columns, "_bucket")
    return df.withColumn(name, bucket_of(df, keys, bits)).join(
        F.broadcast(buckets.select(F.col("bucket").alias(name))), name, "left_semi").drop(name).select(*map(quoted, df.columns))


def diff_by_checksum(before: DataFrame, after: DataFrame, key: Sequence[str] | str,
                     columns: Sequence[str] | None = None, bits: int = BITS,
                     before_checksums: DataFrame | None = None) -> DataFrame:
    """The changed, added and removed rows, as ``table_diff`` returns them.

    ``before_checksums``: what ``checksums`` gave for ``before`` with the same key,
    columns and bits. Key columns must have the same types in both versions, since equal
    keys must meet in one bucket. Equality of buckets is that of 96 bits and a row count."""
    keys = resolve_columns([key] if isinstance(key, str) else key, before.columns)
    shared = [c for c in before.columns if c in after.columns and c not in keys]
    cols = resolve_columns(columns, shared) if columns else shared
    odd = [c for c in keys if before.schema[c].dataType != after.schema[c].dataType]
    if odd:
        raise ValueError(f"key columns {odd} differ in type; cast them first")
    typed = after.select(*[quoted(c).cast(before.schema[c].dataType).alias(c)
                           if c in cols and before.schema[c].dataType != after.schema[c].dataType else quoted(c)
                           for c in after.columns])
    old = checksums(before, keys, cols, bits) if before_checksums is None else before_checksums
    found = differing_buckets(old, checksums(typed, keys, cols, bits), bits)
    return table_diff(rows_in_buckets(before, keys, found, bits), rows_in_buckets(after, keys, found, bits), keys, cols or None)
