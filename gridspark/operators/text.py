"""Text column analysis (L1-L3), over whole values of the whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_column
from gridspark.operators.aggregate import value_key
from gridspark.operators.profile import NUMERIC_TEXT_PATTERN


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def text_lengths(df: DataFrame, column) -> DataFrame:
    """L1: min, max and mean length in characters (nulls skipped)."""
    name = resolve_column(column, df.columns)
    n = F.length(_c(name).cast("string"))
    return df.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"))


def text_issues(df: DataFrame, column) -> DataFrame:
    """L2: leading / trailing spaces, empty (whitespace-only) values, case
    variants (distinct values vs distinct lower-cased values) and
    numeric-looking values (share of non-null values)."""
    name = resolve_column(column, df.columns)
    s = _c(name).cast("string")
    row = df.agg(
        F.count(s).alias("values"),
        F.count_if(s.startswith(" ")).alias("leading_spaces"),
        F.count_if(s.endswith(" ")).alias("trailing_spaces"),
        F.count_if(F.regexp_replace(s, r"^\s+|\s+$", "") == "").alias("empty"),
        F.count_if(s.rlike(NUMERIC_TEXT_PATTERN)).alias("numeric_like"))
    # both distinct counts from one shuffle of short keys
    pairs = df.select(s.alias("s")).select(F.explode(F.array(
        F.struct(F.lit(0).alias("low"), value_key(F.col("s"), T.StringType()).alias("v")),
        F.struct(F.lit(1).alias("low"), value_key(F.lower("s"), T.StringType()).alias("v")))).alias("u")).select(
        "u.low", "u.v").where("v IS NOT NULL").distinct()
    both = pairs.agg(F.struct(F.count_if(F.col("low") == 0).alias("d"), F.count_if(F.col("low") == 1).alias("l"))).scalar()
    row = row.select("values", "leading_spaces", "trailing_spaces", "empty", both["d"].alias("distinct"),
                     both["l"].alias("distinct_lower"), "numeric_like")
    return row.select("*", (F.col("distinct_lower") < F.col("distinct")).alias("case_variants"),
                      (F.col("numeric_like") > F.col("values") * 0.5).alias("mostly_numeric"))


def top_chars(df: DataFrame, column, k: int = 10) -> DataFrame:
    """L3: the ``k`` most frequent characters (spaces skipped), ties by
    character. Characters are exploded and counted with a partial
    aggregate, so texts of any length are processed whole."""
    name = resolve_column(column, df.columns)
    # spaces are skipped: drop them before splitting, so they are never exploded
    text = F.replace(_c(name).cast("string"), F.lit(" "), F.lit(""))
    chars = df.select(F.explode(F.split(text, "")).alias("char"))
    counts = chars.where(F.col("char") != "").groupBy("char").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("char").asc()).limit(k)
