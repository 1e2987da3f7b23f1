"""Table profiling (D1p-D7p): per-column statistics in one wide aggregation,
reshaped to one row per column.

Exact distinct counts come from one shuffle of pre-aggregated
``(column, value)`` pairs (Spark's own multi-distinct rewrite would expand
every row once per column together with all other aggregates);
``exact=False`` switches to HyperLogLog (``approx_count_distinct``). Medians
of all numeric columns are computed at once, by column. Result rows (one per
column) come in no particular order; sort them if needed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import col_letter, resolve_columns
from gridspark.functions.core import FLAG_TEXT_VALUES, to_date
from gridspark.operators.aggregate import NUMERIC, distinct_per_column
from gridspark.plans.ordered import exact_quantiles

# E-mail test (any value matching marks the column), the
# numeric-looking text test, and category size limit.
EMAIL_PATTERN = r"^[\w.-]+@[\w.-]+\.\w+"
NUMERIC_TEXT_PATTERN = r"^-?\d+\.?\d*$"
CATEGORY_MAX = 10


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, NUMERIC):
        return "number"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dt, T.StringType):
        return "text"
    return "other"


def _column_struct(name: str, dt: T.DataType, exact: bool) -> Column:
    c = _c(name)
    k = _kind(dt)
    num = c.cast("double") if k == "number" else F.lit(None).cast("double")
    txt = c.cast("string")
    fields = [
        F.lit(name).alias("column"), F.lit(dt.simpleString()).alias("type"), F.lit(k).alias("kind"),
        F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"),
        F.avg(num).alias("mean"), F.stddev_samp(num).alias("std"),
        F.min(num).alias("min"), F.max(num).alias("max"),
        (F.coalesce(F.bool_and(F.when(c.isNotNull(), c.cast("double").isin(0.0, 1.0))), F.lit(True))
         if k == "number" else F.lit(False)).alias("flag01"),
        (F.coalesce(F.bool_and(F.when(c.isNotNull(), F.lower(txt).isin(*FLAG_TEXT_VALUES))), F.lit(True))
         if k == "text" else F.lit(False)).alias("flagyn"),
        (F.count_if(c.isNotNull() & to_date(c).isNotNull()) if k == "text" else F.lit(0).cast("long"))
        .alias("date_ok"),
        (F.coalesce(F.bool_or(txt.rlike(EMAIL_PATTERN)), F.lit(False)) if k == "text" else F.lit(False))
        .alias("email"),
        (F.count_if(c.isNotNull() & txt.try_cast("double").isNotNull()) if k == "text"
         else F.lit(0).cast("long")).alias("num_ok"),
        (F.count_if(c.isNotNull() & F.regexp_replace(txt, r"^\s+|\s+$", "").eqNullSafe(F.lit("")))
         if k == "text" else F.lit(0).cast("long")).alias("blanks"),
    ]
    return F.struct(*fields)


def semantic_type(s=None) -> Column:
    """D5p: the first matching rule names the column's kind of content.
    Fixed values: the labels, the shares 0.7 and 0.8 and the order of the rules."""
    col = (lambda n: F.col(n)) if s is None else (lambda n: s[n])
    nonnull = col("rows") - col("nulls")
    distinct_all = col("distinct_nonnull") + (col("nulls") > 0).cast("long")
    return (F.when(col("kind") == "bool", "Flag (Boolean)")
            .when((col("kind") == "number") & col("flag01"), "Flag (0/1)")
            .when((col("kind") == "text") & col("flagyn"), "Flag (Yes/No)")
            .when(distinct_all == col("rows"), "ID (Unique)")
            .when(col("kind") == "date", "Date")
            .when((col("kind") == "text") & (nonnull > 0) & (col("date_ok") / nonnull > 0.7),
                  "Date-like string")
            .when((col("kind") == "text") & col("email"), "Email")
            .when(col("distinct_nonnull") <= CATEGORY_MAX,
                  F.concat(F.lit("Category ("), col("distinct_nonnull").cast("string"), F.lit(" values)")))
            .when((col("kind") == "text") & (nonnull > 0) & (col("num_ok") / nonnull > 0.8),
                  "Numeric (stored as text)")
            .otherwise("Free Text"))


def column_facts(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column with the raw counts behind D1p/D5p/D6p."""
    structs = [_column_struct(f.name, f.dataType, exact) for f in df.schema.fields]
    facts = df.agg(F.array(*structs).alias("s")).select(F.posexplode("s").alias("pos", "f"))
    facts = facts.select("pos", "f.*")
    return facts.join(distinct_per_column(df, exact), on="pos", how="left")


def profile(df: DataFrame, exact: bool = True, with_outliers: bool = True) -> DataFrame:
    """D1p/D2p/D5p: per column: type, rows, nulls, null %, distinct (null
    counted as a value), semantic type, mean, median, std, min, max and the
    number of values more than 3 standard deviations from the mean.

    The raw counts (one row per column) are read first; the moments among them
    then go into the counting pass as constants."""
    raw = column_facts(df, exact)
    rows = raw.collect()
    facts = df.sparkSession.createDataFrame(rows, raw.schema)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    out = facts.select(
        "pos", "column", "type", "rows", "nulls",
        F.round(F.try_divide(F.col("nulls") * F.lit(100.0), F.col("rows")), 2).alias("null_pct"),
        (F.col("distinct_nonnull") + (F.col("nulls") > 0).cast("long")).alias("distinct"),
        semantic_type().alias("semantic_type"), "mean", "std", "min", "max")
    if numeric:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), _c(c).cast("double").alias("v")) for c in numeric]))
            .alias("u")).select("u.column", "u.v")
        med = exact_quantiles(long, "v", [0.5], by=["column"]).select(
            "column", F.col("value").alias("median"))
        out = out.join(med, on="column", how="left")
        if with_outliers:
            known = {r["column"]: r for r in rows}

            def far(c):
                mean, std = known[c]["mean"], known[c]["std"]
                if mean is None or std is None or not std > 0:
                    return F.lit(False)
                return F.abs(_c(c).cast("double") - F.lit(mean)) > 3 * F.lit(std)

            o = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(far(c)).alias("outliers_3sd"))
                                 for c in numeric]).alias("s")).select(F.inline("s"))
            out = out.join(o, on="column", how="left")
        else:
            out = out.withColumn("outliers_3sd", F.lit(None).cast("long"))
    else:
        out = out.withColumn("median", F.lit(None).cast("double")).withColumn(
            "outliers_3sd", F.lit(None).cast("long"))
    return out.select("column", "type", "rows", "nulls", "null_pct", "distinct",
                                     "semantic_type", "mean", "median", "std", "min", "max",
                                     "outliers_3sd")


def detect_types(df: DataFrame, exact: bool = True) -> DataFrame:
    """D5p: ``(column, semantic_type)``."""
    facts = column_facts(df, exact)
    return facts.select("column", semantic_type().alias("semantic_type"))


def top_values(df: DataFrame, columns: Sequence | None = None, k: int = 5) -> DataFrame:
    """D3p: the ``k`` most frequent non-null values of each column (as text),
    ties broken by value. Values are counted with a partial aggregate and
    ``row_number() <= k`` is planned as a per-partition group limit, so a
    column with many distinct values is never ranked in one task."""
    cols = resolve_columns(columns, df.columns) if columns else list(df.columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in cols]))
        .alias("u")).select("u.column", "u.value").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def date_ranges(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """D4p: earliest and latest date of every date column and of text
    columns that parse as dates (rate above ``threshold``)."""
    exprs = []
    for f in df.schema.fields:
        k = _kind(f.dataType)
        if k == "date":
            d = _c(f.name).cast("timestamp_ntz") if not isinstance(f.dataType, T.TimestampNTZType) \
                else _c(f.name)
        elif k == "text":
            d = to_date(_c(f.name))
        else:
            continue
        exprs.append(F.struct(F.lit(f.name).alias("column"), F.min(d).alias("first"),
                              F.max(d).alias("last"),
                              F.try_divide(F.count(d).cast("double"), F.count(_c(f.name)).cast("double"))
                              .alias("_rate")))
    if not exprs:
        return df.sparkSession.createDataFrame([], "column string, first timestamp_ntz, last timestamp_ntz")
    row = df.agg(F.array(*exprs).alias("s")).select(F.inline("s"))
    return row.where(F.col("_rate") > threshold).drop("_rate")


def missing_report(df: DataFrame) -> DataFrame:
    """D6p: per column: nulls, null %, blank (whitespace-only) texts, and a
    status: Clean, All Empty, High (> 50 %), Some (> 10 %) or Minor. One pass."""
    def blank(f):
        if _kind(f.dataType) != "text":
            return F.lit(0).cast("long")
        return F.count_if(_c(f.name).isNotNull() & F.regexp_replace(_c(f.name), r"^\s+|\s+$", "").eqNullSafe(F.lit("")))

    row = df.agg(F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"),
        F.count_if(_c(f.name).isNull()).alias("nulls"), blank(f).alias("blanks")) for f in df.schema.fields]).alias("s"))
    facts = row.select(F.inline("s"))
    pct = F.try_divide(F.col("nulls") * F.lit(100.0), F.col("rows"))
    # fixed values: status words and their limits
    status = (F.when((F.col("nulls") == 0) & (F.col("blanks") == 0), "Clean")
              .when(F.col("nulls") == F.col("rows"), "All Empty")
              .when(pct > 50, "High Missing").when(pct > 10, "Some Missing").otherwise("Minor"))
    return facts.select("column", "type", "nulls", F.round(pct, 2).alias("null_pct"),
                                       "blanks", status.alias("status"))


def missing_total(df: DataFrame) -> DataFrame:
    """D6p footer: missing cells over all columns and their share."""
    n = len(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 sum((F.count_if(_c(c).isNull()) for c in df.columns), F.lit(0)).alias("missing"))
    return row.select("missing", (F.col("rows") * n).alias("cells"),
                      F.round(F.try_divide(F.col("missing") * F.lit(100.0), F.col("rows") * n), 2)
                      .alias("pct"))


def inspect_columns(df: DataFrame, top: int = 4, exact: bool = True) -> DataFrame:
    """D7p: letter, name, type, nulls, distinct (non-null) and the ``top``
    most frequent values of every column."""
    facts = column_facts(df, exact)
    letters = F.create_map(*[x for i in range(len(df.columns))
                             for x in (F.lit(i), F.lit(col_letter(i)))])
    tv = top_values(df, k=top).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
        .alias("top_values"))
    return facts.join(tv, on="column", how="left").select(
        F.element_at(letters, F.col("pos")).alias("letter"), "column", "type", "nulls",
        F.col("distinct_nonnull").alias("distinct"), "top_values")
