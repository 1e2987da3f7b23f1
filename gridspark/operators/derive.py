"""Derived and conditional columns, chained text steps, calendar parts
(X1-X17). Each is one projection of built-in expressions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import core as fc
from gridspark.functions.columns import resolve_column, resolve_columns


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def formula(df: DataFrame, name: str, expression: str) -> DataFrame:
    """New (or replaced) column from a Spark SQL expression over
    backticked columns, e.g. ```l_extendedprice` * (1 - `l_discount`)``."""
    return df.withColumn(name, F.expr(expression))


def _operand(v) -> Column:
    """A literal, or a column when written as ```name```."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str) and len(v) > 2 and v.startswith("`") and v.endswith("`"):
        return F.col(v)
    return F.lit(v)


def if_then_else(df: DataFrame, name: str, condition: str, then, otherwise) -> DataFrame:
    """``then`` where the condition holds, else ``otherwise`` (a null
    condition counts as false). Values are literals (text works) or
    ```column``` references."""
    cond = F.coalesce(F.expr(condition), F.lit(False))
    return df.withColumn(name, F.when(cond, _operand(then)).otherwise(_operand(otherwise)))


def condition_count(df: DataFrame, condition: str) -> DataFrame:
    """Rows matching a condition, and all rows."""
    return df.agg(F.count_if(F.coalesce(F.expr(condition), F.lit(False))).alias("matches"),
                  F.count(F.lit(1)).alias("rows"))


def map_values(df: DataFrame, column, mapping: dict, default=None, name: str | None = None) -> DataFrame:
    """Replace values through a small inline dictionary (keys compared
    after trimming the text); unmapped values take ``default`` or, when it
    is None, stay as they were. The dictionary becomes a literal map."""
    col = resolve_column(column, df.columns)
    out = name or col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(v))])
    key = F.trim(_c(col).cast("string"))
    hit = F.try_element_at(m, key)
    fallback = F.lit(default) if default is not None else _c(col).cast("string")
    return df.withColumn(out, F.when(hit.isNotNull(), hit).otherwise(fallback))


def map_values_table(df: DataFrame, column, mapping: DataFrame, key: str, value: str,
                     default=None, name: str | None = None) -> DataFrame:
    """X4 for a mapping kept as a table (any size): a left join on the
    trimmed key. A key given twice with different values fails at run time."""
    col = resolve_column(column, df.columns)
    out = name or col
    mp = mapping.select(F.trim(_c(key).cast("string")).alias("__mk"), _c(value).alias("__mv")).where("__mk IS NOT NULL")
    one = (F.count("__mv") == F.count(F.lit(1))) & F.min("__mv").eqNullSafe(F.max("__mv")) | (F.count("__mv") == 0)
    clash = F.raise_error(F.concat(F.lit("mapping key given twice with different values: "), F.col("__mk")))
    mp = mp.groupBy("__mk").agg(F.min("__mv").alias("__mv"), one.alias("__one")).select(
        "__mk", F.when(F.col("__one"), F.col("__mv")).otherwise(clash.cast(mp.schema["__mv"].dataType)).alias("__mv"))
    j = df.join(mp, F.trim(df[f"`{col}`"].cast("string")) == F.col("__mk"), "left")
    fallback = F.lit(default) if default is not None else df[f"`{col}`"].cast("string")
    res = F.when(F.col("__mk").isNotNull(), F.col("__mv")).otherwise(fallback)
    keep = [df[f"`{c}`"] for c in df.columns if c != out]
    return j.select(*keep, res.alias(out)).select(*df.columns, *([out] if out not in df.columns else []))


TEXT_STEPS = ("upper", "lower", "strip", "title", "int", "float", "clean_number", "len", "round",
              "date", "fill", "extract")


def text_step(c: Column, step) -> Column:
    """One step of a chain: a name, or ``(name, argument)`` for round, date,
    fill and extract."""
    name, arg = (step, None) if isinstance(step, str) else (step[0], step[1])
    if name == "upper":
        return F.upper(c.cast("string"))
    if name == "lower":
        return F.lower(c.cast("string"))
    if name == "strip":
        return fc.strip(c)
    if name == "title":
        return fc.title(c)
    if name == "int":
        return fc.to_int(c)
    if name == "float":
        return fc.to_float(c)
    if name == "clean_number":
        return fc.clean_number(c)
    if name == "len":
        return F.length(c.cast("string"))
    if name == "round":
        return F.bround(c.cast("double"), int(arg or 0))
    if name == "date":
        return fc.to_date(c, arg)
    if name == "fill":
        return F.coalesce(c, F.lit(arg))
    if name == "extract":
        return fc.extract(c, arg)
    raise ValueError(f"unknown step {name!r}; choose from {TEXT_STEPS}")


def transform_column(df: DataFrame, column, steps: Sequence, name: str | None = None) -> DataFrame:
    """Apply a chain of steps to a column as one fused expression."""
    col = resolve_column(column, df.columns)
    e = _c(col)
    for s in steps:
        e = text_step(e, s)
    return df.withColumn(name or col, e)


def date_parts(df: DataFrame, column, parts: Sequence[str] = ("year", "month", "day", "weekday", "quarter")
               ) -> DataFrame:
    """Add ``<col>_<part>`` columns (weekday: Monday = 0)."""
    col = resolve_column(column, df.columns)
    return df.select("*", *[fc.date_part(_c(col), p).alias(f"{col}_{p}") for p in parts])


def day_difference(df: DataFrame, a, b=None, now=None, name: str = "days") -> DataFrame:
    """Whole days ``a - b`` floored (``b`` a column, or the fixed
    ``now`` timestamp, which must be passed explicitly for reproducibility)."""
    ca = resolve_column(a, df.columns)
    if b is not None:
        other = _c(resolve_column(b, df.columns))
    elif now is not None:
        other = F.lit(str(now)).cast("timestamp_ntz")
    else:
        raise ValueError("give a second column b or a fixed now timestamp")
    return df.withColumn(name, fc.day_diff(_c(ca), other))


def round_column(df: DataFrame, column, digits: int = 0, half_even: bool = True) -> DataFrame:
    """X11: round half-even (like pandas) or half-up."""
    col = resolve_column(column, df.columns)
    fn = F.bround if half_even else F.round
    return df.withColumn(col, fn(_c(col), digits))
