"""Keyed table diff (G1)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_columns


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def table_diff(before: DataFrame, after: DataFrame, key: Sequence[str] | str,
               columns: Sequence[str] | None = None, only_changes: bool = True) -> DataFrame:
    """G1: compare two versions of a table row by row on a unique ``key``.

    One full outer join (a null key equals a null key); per row: ``status`` (added / removed / changed /
    same), ``changed_cells`` (null-safe comparison of each shared column)
    and ``changed_columns`` (their names, comma-separated). ``only_changes`` drops unchanged rows.
    """
    keys = resolve_columns([key] if isinstance(key, str) else key, before.columns)
    shared = [c for c in before.columns if c in after.columns and c not in keys]
    cols = resolve_columns(columns, shared) if columns else shared
    b = before.select(*[_c(k) for k in keys], *[_c(c).alias(f"b__{c}") for c in cols],
                      F.lit(True).alias("__in_b"))
    a = after.select(*[_c(k).alias(f"a__{k}") for k in keys], *[_c(c).alias(f"a__{c}") for c in cols],
                     F.lit(True).alias("__in_a"))
    cond = [b[f"`{k}`"].eqNullSafe(a[f"`a__{k}`"]) for k in keys]
    j = b.join(a, on=cond, how="full_outer")
    diffs = [F.when(~_c(f"b__{c}").eqNullSafe(_c(f"a__{c}")), F.lit(c)) for c in cols]
    changed = F.filter(F.array(*diffs), lambda x: x.isNotNull()) if cols else F.array().cast("array<string>")
    status = (F.when(F.col("__in_b").isNull(), "added").when(F.col("__in_a").isNull(), "removed")
              .when(F.size(changed) > 0, "changed").otherwise("same"))
    out = j.select(*[F.coalesce(_c(k), _c(f"a__{k}")).alias(k) for k in keys],
                   status.alias("status"),
                   F.when(F.col("__in_b").isNotNull() & F.col("__in_a").isNotNull(), F.size(changed))
                   .otherwise(F.lit(len(cols))).cast("long").alias("changed_cells"),
                   F.concat_ws(",", F.when(F.col("__in_b").isNotNull() & F.col("__in_a").isNotNull(), changed)
                               .otherwise(F.array(*[F.lit(c) for c in cols]).cast("array<string>")))
                   .alias("changed_columns"))
    return out.where(F.col("status") != "same") if only_changes else out


def diff_summary(before: DataFrame, after: DataFrame, key, columns=None) -> DataFrame:
    """G1 counts: rows before/after and rows per status, changed cells."""
    d = table_diff(before, after, key, columns, only_changes=False)
    return d.agg(
        F.count_if(F.col("status") != "added").alias("rows_before"),
        F.count_if(F.col("status") != "removed").alias("rows_after"),
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"),
        F.count_if(F.col("status") == "changed").alias("changed"),
        F.coalesce(F.sum(F.when(F.col("status") == "changed", F.col("changed_cells"))), F.lit(0))
        .cast("long").alias("changed_cells"))
