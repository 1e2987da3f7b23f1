"""Column issue scan and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_column
from gridspark.functions.core import strip, to_date
from gridspark.operators.aggregate import distinct_per_column

# Fixed rule parameters of the issue scan.
HIGH_NULL_SHARE = 0.9
UNIQUE_MIN_ROWS = 10
FLOAT_ID_TOLERANCE = 0.1
FLOAT_ID_MAGNITUDE = 1e15
DATE_SHARE = 0.7
INT_TEXT = r"^\d+$"
DECIMAL_TEXT = r"^(\d+\.\d*|\.\d+)$"
LETTER = r"\p{L}"

ISSUES = ("high_nulls", "unique_values", "float_id_precision", "date_like_strings", "mixed_types")


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def issue_scan(df: DataFrame) -> DataFrame:
    """``(column, issue)`` rows from one aggregation pass over the
    whole table (every value is examined; nothing is sampled)."""
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = _c(f.name)
        n = F.count(F.lit(1))
        nulls = F.count_if(c.isNull())
        checks = [
            F.when(F.try_divide(nulls.cast("double"), n.cast("double")) >= HIGH_NULL_SHARE, "high_nulls"),
            # unique_values needs the distinct count, joined below
            F.when((n > UNIQUE_MIN_ROWS) & (nulls <= 1), "__maybe_unique"),
        ]
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            intlike = F.bool_and(F.when(c.isNotNull(), F.abs(c - F.round(c)) < FLOAT_ID_TOLERANCE))
            large = F.bool_or(F.abs(c) >= FLOAT_ID_MAGNITUDE)
            checks.append(F.when(F.coalesce(intlike & large, F.lit(False)), "float_id_precision"))
        if isinstance(f.dataType, T.StringType):
            nonnull = F.count(c)
            rate = F.try_divide(F.count_if(c.isNotNull() & to_date(c).isNotNull()).cast("double"),
                                nonnull.cast("double"))
            checks.append(F.when(rate >= DATE_SHARE, "date_like_strings"))
            kinds = (F.coalesce(F.bool_or(c.rlike(INT_TEXT)), F.lit(False)).cast("int")
                     + F.coalesce(F.bool_or(c.rlike(DECIMAL_TEXT)), F.lit(False)).cast("int")
                     + F.coalesce(F.bool_or(c.rlike(LETTER)), F.lit(False)).cast("int"))
            checks.append(F.when(kinds >= 2, "mixed_types"))
        structs.append(F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("column"),
                                F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"),
                                F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("issues")))
    row = df.agg(F.array(*structs).alias("s")).select(F.inline("s"))
    row = row.join(distinct_per_column(df), on="pos", how="left")
    unique = (F.col("distinct_nonnull") + (F.col("nulls") > 0).cast("long")) == F.col("rows")
    issues = F.transform(F.col("issues"), lambda x: F.when(x == "__maybe_unique",
                                                            F.when(unique, F.lit("unique_values"))).otherwise(x))
    out = row.select("pos", "column", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))
    return out.drop("pos")


def apply_fix(df: DataFrame, column, issue: str) -> DataFrame:
    """C20: the standard fix for one issue of one column.

    date_like_strings -> parsed dates; float_id_precision -> long (null beyond its range);
    high_nulls -> column dropped; unique_values -> ``<col>_is_id`` flag;
    mixed_types -> numbers when every non-null value parses, else trimmed
    text (the one boolean deciding the result type is read first).
    """
    name = resolve_column(column, df.columns)
    c = _c(name)
    if issue == "date_like_strings":
        return df.withColumn(name, to_date(c))
    if issue == "float_id_precision":
        return df.withColumn(name, F.bround(c, 0).try_cast("long"))
    if issue == "high_nulls":
        return df.drop(name)
    if issue == "unique_values":
        return df.withColumn(f"{name}_is_id", F.lit(True))
    if issue == "mixed_types":
        all_num = df.agg(F.coalesce(F.bool_and(F.when(c.isNotNull(), c.try_cast("double").isNotNull())),
                                    F.lit(True)).alias("ok")).first()["ok"]
        return df.withColumn(name, c.try_cast("double") if all_num else strip(c))
    raise ValueError(f"unknown issue {issue!r}; choose from {ISSUES}")
