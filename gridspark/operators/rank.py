"""Ranking with every tie method.

The default strategy ``"auto"`` first measures the largest group (one
aggregation). Groups proven to fit one task (``gridspark.singleTaskRows``,
2 million rows by default) are ranked with plain window functions; larger
ones through the position table of ``plans.ordered``: repeated values
collapse in a partial aggregate, the distinct values are range-bucketed and
the ranks are joined back, so no group (not even one holding a third of the
rows) and no global ordering is gathered into a single task.

Null values and null groups get a null rank and do not count towards the
percentile denominator.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column, resolve_columns
from gridspark.functions.names import plain_names
from gridspark.plans.ordered import RANK_METHODS, attach_ranks, positions, rank_expr, row_numbers

METHOD_ALIASES = {"ordinal": "first", "standard": "first", "pct": "percentile", "avg": "average",
                  "mean": "average"}


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def canonical_method(method: str) -> str:
    m = METHOD_ALIASES.get(method.lower(), method.lower())
    if m not in RANK_METHODS:
        raise ValueError(f"unknown rank method {method!r}; choose from {RANK_METHODS}")
    return m


def _cast(method: str, c: Column) -> Column:
    return c.cast("double") if method in ("average", "percentile") else c.cast("long")


def rank(df: DataFrame, columns, method: str = "min", group=None, ascending=False,
         name: str | None = None, tiebreak: Sequence[str] = (), strategy: str = "auto",
         n_buckets: int | None = None) -> DataFrame:
    """Add a rank column (default ``<first column>_rank``).

    ``columns`` is one column or several (lexicographic order); ``ascending``
    one shared direction or one per column (default: largest first).
    ``method`` is one of min, max, average, first (ordinal), dense,
    percentile. ``first`` breaks ties by the ``tiebreak`` columns, then by
    scan order. ``strategy``: ``auto`` checks the largest group and uses a
    plain window when it fits one task, else the bucketed position table;
    ``window`` does the same, since a plain window over a larger group would
    gather it in one task; ``positions`` forces the table; ``n_buckets`` sets
    the number of range buckets of the position table.
    """
    cols = resolve_columns([columns] if isinstance(columns, (str, int)) else columns, df.columns)
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(cols)
    frame, to = plain_names(df)
    order = list(zip([to[c] for c in cols], [bool(a) for a in asc]))
    by = resolve_columns([group] if isinstance(group, (str, int)) else group, df.columns) if group else []
    m = canonical_method(method)
    out_name = name or f"{cols[0]}_rank"
    if m == "first":
        tb = [(to[resolve_column(t, df.columns)], True) for t in tiebreak]
        res = row_numbers(frame, order + tb, [to[b] for b in by], name="_r", strategy=strategy, n_buckets=n_buckets)
    else:
        res = attach_ranks(frame, order, [to[b] for b in by], {"_r": m}, strategy=strategy, n_buckets=n_buckets)
    return res.select(*[_c(to[c]).alias(c) for c in df.columns], _cast(m, F.col("_r")).alias(out_name))


def ranks(df: DataFrame, columns, methods: dict, group=None, ascending=False,
          strategy: str = "auto") -> DataFrame:
    """Several tie methods at once, ``{output name: method}`` (not
    ``first``), sharing one ordering pass."""
    cols = resolve_columns([columns] if isinstance(columns, (str, int)) else columns, df.columns)
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(cols)
    frame, to = plain_names(df)
    order = list(zip([to[c] for c in cols], [bool(a) for a in asc]))
    by = resolve_columns([group] if isinstance(group, (str, int)) else group, df.columns) if group else []
    ms = {n: canonical_method(m) for n, m in methods.items()}
    if "first" in ms.values():
        raise ValueError("use rank(..., 'first') for ordinal ranks")
    tmp = {f"_r{i}": m for i, m in enumerate(ms.values())}
    res = attach_ranks(frame, order, [to[b] for b in by], tmp, strategy=strategy)
    return res.select(*[_c(to[c]).alias(c) for c in df.columns],
                      *[_cast(m, F.col(t)).alias(n) for (n, m), t in zip(ms.items(), tmp)])


def top_n_ranked(df: DataFrame, column, n: int, method: str = "min", group=None,
                 ascending: bool = False, name: str | None = None,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows whose rank is at most ``n`` (ties kept), with the rank.

    Only candidate values are ranked: repeated values are collapsed first,
    ``dense_rank() <= n`` over the distinct values is planned as a
    ``WindowGroupLimit`` (a per-partition limit before the shuffle), and the
    surviving keys (at most ``n`` per group) are joined back to the rows.
    Method ``first`` keeps exactly ``n`` rows per group by
    ``row_number() <= n`` (also a ``WindowGroupLimit``).
    """
    col = resolve_column(column, df.columns)
    by = resolve_columns([group] if isinstance(group, (str, int)) else group, df.columns) if group else []
    m = canonical_method(method)
    out_name = name or f"{col}_rank"
    frame, to = plain_names(df)
    col, by, ties = to[col], [to[b] for b in by], [to[resolve_column(t, df.columns)] for t in tiebreak]
    rows = [_c(to[c]).alias(c) for c in df.columns]
    key = _c(col).asc() if ascending else _c(col).desc()
    base = frame.where(_c(col).isNotNull())
    for b in by:
        base = base.where(_c(b).isNotNull())
    if m == "first":
        w = Window.partitionBy(*[_c(b) for b in by]).orderBy(key, *[_c(t).asc() for t in ties])
        return base.withColumn("_r", F.row_number().over(w).cast("long")).where(
            F.col("_r") <= n).select(*rows, F.col("_r").alias(out_name))
    if m == "percentile":
        raise ValueError("use top_percent for percentile ranks")
    counts = base.groupBy(*[_c(b) for b in by], _c(col)).agg(F.count(F.lit(1)).alias("_n"))
    wd = Window.partitionBy(*[_c(b) for b in by]).orderBy(key)
    cands = counts.withColumn("_dense", F.dense_rank().over(wd)).where(F.col("_dense") <= n)
    wc = wd.rowsBetween(Window.unboundedPreceding, -1)
    cands = cands.withColumn("_before", F.coalesce(F.sum("_n").over(wc), F.lit(0)))
    cands = cands.withColumn("_r", rank_expr(m)).where(F.col("_r") <= n)
    keep = cands.select(*[_c(b) for b in by], _c(col), _cast(m, F.col("_r")).alias("_rank"))
    return base.join(keep, on=by + [col], how="inner").select(*rows, F.col("_rank").alias(out_name))


def top_percent(df: DataFrame, column, percent: float, group=None, ascending: bool = False,
                name: str | None = None) -> DataFrame:
    """Rows in the best ``percent`` % by percentile rank (average-tie
    percentile in the chosen direction: largest first unless ``ascending``)."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must be within 0..100")
    col = resolve_column(column, df.columns)
    out_name = name or f"{col}_rank"
    ranked = rank(df, col, "percentile", group=group, ascending=ascending, name=out_name)
    return ranked.where(F.col(out_name) <= F.lit(percent / 100.0))


def category_codes(df: DataFrame, column, name: str | None = None) -> DataFrame:
    """C14 helper: dense 0-based code of each distinct value in sorted order
    (null stays null), via the position table."""
    col = resolve_column(column, df.columns)
    frame, to = plain_names(df)
    pos = positions(frame, [to[col]]).select(_c(to[col]), (F.col("_dense") - 1).cast("long").alias("_code"))
    return frame.join(pos, on=[to[col]], how="left").select(
        *[_c(to[c]).alias(c) for c in df.columns], F.col("_code").alias(name or f"{col}_code"))
