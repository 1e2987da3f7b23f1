"""Grouped and whole-table aggregation.

All statistics are computed in one aggregation pass where Spark allows
(partial aggregation on the map side, so a hot key costs one row per map
task). Medians and quantiles are exact: Spark's ``percentile`` keeps a value
map per group in one task, so it is used only when the largest group is
measured to fit one task (``strategy="auto"``); bigger groups go through the
bucketed position table of ``plans.ordered``. ``exact=False`` switches to
``percentile_approx`` (one pass, bounded memory).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_column, resolve_columns
from gridspark.functions.names import free_name, plain_names
from gridspark.plans.ordered import exact_quantiles, largest_group, null_safe_join, single_task_rows

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)

AGG_FUNCS = ("count", "size", "sum", "mean", "median", "min", "max", "nunique", "std", "var")
_ALIASES = {"avg": "mean", "average": "mean", "distinct": "nunique", "n_unique": "nunique",
            "stddev": "std", "variance": "var", "len": "size"}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def canonical_agg(func: str) -> str:
    f = _ALIASES.get(func.strip().lower(), func.strip().lower())
    if f not in AGG_FUNCS:
        raise ValueError(f"unknown aggregate {func!r}; choose from {AGG_FUNCS}")
    return f


def agg_expr(func: str, column: str, exact: bool = True) -> Column:
    """Aggregate expression by whitelisted name. ``sum`` of an all-null group
    is 0; ``count`` counts non-null values, ``size`` counts rows."""
    f = canonical_agg(func)
    c = _c(column)
    if f == "count":
        return F.count(c)
    if f == "size":
        return F.count(F.lit(1))
    if f == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if f == "mean":
        return F.avg(c)
    if f == "median":
        if exact:
            raise ValueError("exact median is computed by aggregate(), not agg_expr()")
        return F.percentile_approx(c, 0.5, 10000)
    if f == "min":
        return F.min(c)
    if f == "max":
        return F.max(c)
    if f == "nunique":
        return F.count_distinct(c) if exact else F.approx_count_distinct(c)
    if f == "std":
        return F.stddev_samp(c)
    if f == "var":
        return F.var_samp(c)
    raise AssertionError(f)


def aggregate(df: DataFrame, by: Sequence[str], specs: Sequence[tuple[str, str, str]],
              exact: bool = True, strategy: str = "auto") -> DataFrame:
    """General grouped aggregation: ``specs`` = ``[(column, func, alias)]``.

    Null group keys form their own group. Exact medians are joined on the
    group keys (null-safe) from the position table.
    """
    by = list(by)
    plain = [(c, f, a) for c, f, a in specs if not (canonical_agg(f) == "median" and exact)]
    medians = [(c, f, a) for c, f, a in specs if canonical_agg(f) == "median" and exact]
    exprs = [agg_expr(f, c, exact).alias(a) for c, f, a in plain]
    if not exprs:
        exprs = [F.count(F.lit(1)).alias(free_name([*by, *[a for _, _, a in specs]], "_n"))]
    out = df.groupBy(*[_c(b) for b in by]).agg(*exprs)
    frame, to = plain_names(df)
    for c, _, a in medians:
        med = exact_quantiles(frame, to[c], [0.5], [to[b] for b in by], null_groups=True, strategy=strategy).select(
            *[_c(to[b]).alias(b) for b in by], F.col("value").alias(a))
        if by:
            out = null_safe_join(out, med, by, how="left")
        else:
            out = out.select("*", med.select(a).scalar().alias(a))
    return out.select(*[_c(b) for b in by], *[_c(a) for _, _, a in specs])


def row_count(df: DataFrame) -> DataFrame:
    """The row count as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def count_by(df: DataFrame, column) -> DataFrame:
    """A2: rows per value, most frequent first (null is a group)."""
    name = resolve_column(column, df.columns)
    return df.groupBy(_c(name)).agg(F.count(F.lit(1)).alias("Count")).orderBy(
        F.col("Count").desc(), _c(name).asc_nulls_last())


def sum_by(df: DataFrame, key, value) -> DataFrame:
    """A3: ``Sum_<value>`` per key; an all-null group sums to 0."""
    k, v = resolve_column(key, df.columns), resolve_column(value, df.columns)
    return df.groupBy(_c(k)).agg(agg_expr("sum", v).alias(f"Sum_{v}")).orderBy(_c(k).asc_nulls_last())


def avg_by(df: DataFrame, key, value, digits: int = 2) -> DataFrame:
    """A4: ``Avg_<value>`` per key, rounded half-even to ``digits``."""
    k, v = resolve_column(key, df.columns), resolve_column(value, df.columns)
    return df.groupBy(_c(k)).agg(F.bround(F.avg(_c(v)), digits).alias(f"Avg_{v}")).orderBy(
        _c(k).asc_nulls_last())


def custom_agg(df: DataFrame, value, func: str, key=None, exact: bool = True,
               strategy: str = "auto") -> DataFrame:
    """A5: one of count, sum, mean, median, min, max per group, or over the
    whole table when ``key`` is None. Output column ``<func>_<value>``."""
    v = resolve_column(value, df.columns)
    f = canonical_agg(func)
    by = [resolve_column(key, df.columns)] if key is not None else []
    out = aggregate(df, by, [(v, f, f"{f}_{v}")], exact=exact, strategy=strategy)
    return out


def agg_multi(df: DataFrame, key, columns: Sequence, func: str, exact: bool = True) -> DataFrame:
    """One function over several columns, ``<func>_<col>``, sorted by key."""
    k = resolve_column(key, df.columns)
    cols = resolve_columns(columns, df.columns)
    f = canonical_agg(func)
    out = aggregate(df, [k], [(c, f, f"{f}_{c}") for c in cols], exact=exact)
    return out.orderBy(_c(k).asc_nulls_last())


def agg_map(df: DataFrame, keys: Sequence, funcs: dict, exact: bool = True) -> DataFrame:
    """Several keys, a function per column; output keeps column names."""
    ks = resolve_columns(keys, df.columns)
    specs = [(resolve_column(c, df.columns), f, resolve_column(c, df.columns)) for c, f in funcs.items()]
    return aggregate(df, ks, specs, exact=exact)


def group_summary(df: DataFrame, keys: Sequence, func: str = "count", value=None,
                  exact: bool = True) -> DataFrame:
    """Multi-key summary (row count, or one aggregate of ``value``)
    sorted by the result, largest first."""
    ks = resolve_columns(keys, df.columns)
    f = canonical_agg(func)
    if f in ("count", "size") and value is None:
        out = df.groupBy(*[_c(k) for k in ks]).agg(F.count(F.lit(1)).alias("Count"))
        name = "Count"
    else:
        v = resolve_column(value, df.columns)
        name = f"{f}_{v}"
        out = aggregate(df, ks, [(v, f, name)], exact=exact)
    return out.orderBy(F.col(name).desc_nulls_last(), *[_c(k).asc_nulls_last() for k in ks])


def distinct_counts(df: DataFrame, columns: Sequence | None = None, exact: bool = True) -> DataFrame:
    """``(column, n_distinct)`` (nulls not counted); exact counts shuffle
    pre-aggregated (column, value) pairs, ``exact=False`` sketches in one pass."""
    cols = resolve_columns(columns, df.columns) if columns else df.columns
    if exact:
        names = F.array(*[F.lit(c) for c in cols])
        return distinct_per_column(df.select(*[_c(c) for c in cols])).select(
            F.element_at(names, F.col("pos") + 1).alias("column"), F.col("distinct_nonnull").alias("n_distinct"))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.approx_count_distinct(_c(c)).alias("n_distinct"))
                           for c in cols]).alias("s"))
    return row.select(F.inline("s"))


def value_key(c: Column, dtype: T.DataType) -> Column:
    """Text that two non-null values share exactly when they are equal: 0.0 and
    -0.0 are one value, and a long text is represented by its SHA-256."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    text = c.cast("string")
    if isinstance(dtype, T.StringType):
        return F.when(F.octet_length(text) > 64, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
    return text


def distinct_per_column(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(pos, distinct_nonnull)`` for every column.

    Exact counts unpivot to ``(column, value)`` and count distinct pairs:
    one shuffle of pre-aggregated pairs, instead of Spark's multi-distinct
    rewrite that expands every row once per column together with all other
    aggregates. ``exact=False`` uses HyperLogLog in one pass.
    """
    fields = list(enumerate(df.schema.fields))
    if not exact:
        row = df.agg(F.array(*[F.struct(F.lit(i).alias("pos"),
                                        F.approx_count_distinct(_c(f.name)).alias("distinct_nonnull"))
                               for i, f in fields]).alias("s"))
        return row.select(F.inline("s"))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), value_key(_c(f.name), f.dataType).alias("v"))
        for i, f in fields])).alias("u")).select("u.pos", "u.v")
    pairs = long.where("v IS NOT NULL").select("pos", "v").distinct()
    counted = pairs.groupBy("pos").agg(F.count(F.lit(1)).alias("distinct_nonnull"))
    all_pos = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("pos"))
    return all_pos.join(counted, on="pos", how="left").select(
        "pos", F.coalesce("distinct_nonnull", F.lit(0)).cast("long").alias("distinct_nonnull"))


def value_counts(df: DataFrame, column, normalize: bool = False) -> DataFrame:
    """A10: count per non-null value, most frequent first (ties by value);
    ``normalize`` adds the share of non-null rows."""
    name = resolve_column(column, df.columns)
    out = df.where(_c(name).isNotNull()).groupBy(_c(name)).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = df.select(F.count(_c(name))).scalar()
        out = out.withColumn("share", F.col("count") / total)
    return out.orderBy(F.col("count").desc(), _c(name).asc())


def distinct_rows(df: DataFrame, subset: Sequence | None = None) -> DataFrame:
    """Distinct rows (or distinct values of ``subset``)."""
    if subset:
        return df.select(*[_c(c) for c in resolve_columns(subset, df.columns)]).distinct()
    return df.distinct()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _unpivot_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("double").alias("v")) for c in cols])).alias("u")
    ).select("u.column", "u.v")


def numeric_summary(df: DataFrame, columns: Sequence[str], qs: Sequence[float],
                    digits: int | None = None, exact: bool = True, strategy: str = "auto") -> DataFrame:
    """One row per column: count, mean, std, min, ``p<q>``..., max.

    Moments come from one aggregation. Exact quantiles: when the table is
    measured to fit one task, the same aggregation also sorts each column's
    values once (one pass, no join); otherwise the position table of all
    columns at once (unpivoted to ``(column, value)``) is used.
    """
    cols = list(columns)
    names = [f"p{round(q * 100):d}" if abs(q * 100 - round(q * 100)) < 1e-9 else f"p{q}" for q in qs]
    stat_cols = ["mean", "std", "min"] + names + ["max"]
    long = _unpivot_numeric(df, cols)
    if exact and strategy in ("auto", "window") and largest_group(df, [], []) <= single_task_rows(df):
        # every column fits one task: one aggregation by column computes the
        # moments and sorts the column's values once (columns in parallel)
        def q_of(srt, q):
            n = F.size(srt)
            p = F.lit(float(q)) * F.greatest(n - 1, F.lit(0))     # an empty list gives null
            lo, hi = F.floor(p), F.ceil(p)
            vlo = F.try_element_at(srt, (lo + 1).cast("int"))
            vhi = F.try_element_at(srt, (hi + 1).cast("int"))
            return vlo + (vhi - vlo) * (p - lo)

        per = long.groupBy("column").agg(
            F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max"),
            F.array_sort(F.collect_list("v")).alias("_s"))
        out = per.select("column", "count", "mean", "std", "min",
                         *[q_of(F.col("_s"), q).alias(n) for q, n in zip(qs, names)], "max")
        if digits is not None:
            out = out.select("column", "count", *[F.round(F.col(s), digits).alias(s) for s in stat_cols])
        return out.select("column", "count", *stat_cols)
    moments = df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count(_c(c)).alias("count"),
        F.avg(_c(c).cast("double")).alias("mean"), F.stddev_samp(_c(c).cast("double")).alias("std"),
        F.min(_c(c).cast("double")).alias("min"), F.max(_c(c).cast("double")).alias("max"))
        for c in cols]).alias("s")).select(F.inline("s"))
    if exact:
        qv = exact_quantiles(long, "v", qs, by=["column"], strategy=strategy)
        wide = qv.groupBy("column").agg(*[
            F.max(F.when(F.abs(F.col("q") - q) < 1e-12, F.col("value"))).alias(n)
            for q, n in zip(qs, names)])
    else:
        wide = long.groupBy("column").agg(F.percentile_approx("v", list(qs), 10000).alias("_a")).select(
            "column", *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])
    out = moments.join(wide, on="column", how="left")
    if digits is not None:
        out = out.select("column", "count", *[F.round(F.col(s), digits).alias(s) for s in stat_cols])
    return out.select("column", "count", *stat_cols)


def describe(df: DataFrame, columns: Sequence | None = None, exact: bool = True,
             strategy: str = "auto") -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per numeric column."""
    cols = resolve_columns(columns, df.columns) if columns else numeric_columns(df)
    return numeric_summary(df, cols, [0.25, 0.5, 0.75], exact=exact, strategy=strategy)


def column_stats(df: DataFrame, columns: Sequence | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, std, min, percentiles 10/25/50/75/90/95, max,
    rounded to 4 digits."""
    cols = resolve_columns(columns, df.columns) if columns else numeric_columns(df)
    return numeric_summary(df, cols, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95], digits=4, exact=exact)


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, nulls)`` for every column in one pass."""
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"),
                                    F.count_if(_c(c).isNull()).alias("nulls"))
                           for c in df.columns]).alias("s"))
    return row.select(F.inline("s"))


def corr_matrix(df: DataFrame, columns: Sequence | None = None) -> DataFrame:
    """Pearson correlation matrix (pairwise complete rows), one row per
    column. Every pair is computed once, in a single aggregation; a constant
    column correlates as null instead of failing on division by zero, any other
    column as 1 with itself."""
    cols = resolve_columns(columns, df.columns) if columns else numeric_columns(df)

    def pair(a, b):
        x, y = _c(a).cast("double"), _c(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        xs, ys = F.when(both, x), F.when(both, y)
        return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))

    own = [F.when(F.stddev_samp(_c(a).cast("double")) > 0, F.lit(1.0)).alias(f"{i}_{i}")
           for i, a in enumerate(cols)]
    row = df.agg(*own, *[pair(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols)
                         for j, b in enumerate(cols) if i < j])
    rows = F.array(*[F.struct(F.lit(a).alias("column"),
                              *[F.col(f"{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(cols)])
                     for i, a in enumerate(cols)])
    return row.select(F.inline(rows))
