"""Search: full text over all columns, fuzzy value search, fuzzy matching
to a list (Q1-Q3). Scores are ``100 * (1 - levenshtein / longer length)`` on
lower-cased text, computed once per distinct value."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column, resolve_columns
from gridspark.functions.core import similarity


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def search_all(df: DataFrame, term: str, columns: Sequence | None = None, case: bool = False) -> DataFrame:
    """Q1: rows where any column's text contains ``term`` (literal,
    case-insensitive unless ``case``). A map-only filter."""
    cols = resolve_columns(columns, df.columns) if columns else list(df.columns)
    t = term if case else term.lower()
    cond = F.lit(False)
    for c in cols:
        s = _c(c).cast("string")
        cond = cond | F.coalesce((s if case else F.lower(s)).contains(t), F.lit(False))
    return df.where(cond)


def fuzzy_search(df: DataFrame, column, query: str, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """Q2: the ``k`` distinct values most similar to ``query`` with score
    and row count (ties by value)."""
    name = resolve_column(column, df.columns)
    vals = df.where(_c(name).isNotNull()).groupBy(_c(name).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    scored = vals.select("value", similarity(F.col("value"), F.lit(query)).alias("score"), "count")
    return scored.where(F.col("score") >= min_score).orderBy(
        F.col("score").desc(), F.col("value").asc()).limit(k)


def suggest_values(df: DataFrame, column, choices: Sequence[str], threshold: float = 60.0) -> DataFrame:
    """Q3: for every distinct value, the closest entry of ``choices`` (a
    bounded list, inlined as literals: no join) with its score; below
    ``threshold`` the match is null. Ties go to the earlier choice."""
    if not choices:
        raise ValueError("choices must not be empty")
    name = resolve_column(column, df.columns)
    vals = df.where(_c(name).isNotNull()).groupBy(_c(name).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    cands = F.array(*[F.struct(similarity(F.col("value"), F.lit(ch)).alias("score"),
                               F.lit(-i).alias("neg_pos"), F.lit(ch).alias("choice"))
                      for i, ch in enumerate(choices)])
    best = vals.select("value", "count", F.array_max(cands).alias("b"))
    ok = F.col("b.score") >= threshold
    return best.select("value", F.when(ok, F.col("b.choice")).alias("match"),
                       F.col("b.score").alias("score"), "count")


def fuzzy_replace(df: DataFrame, column, choices: Sequence[str], threshold: float = 60.0) -> DataFrame:
    """Q3 applied: replace each value by its closest choice when the score
    reaches ``threshold`` (values below it are kept)."""
    name = resolve_column(column, df.columns)
    m = suggest_values(df, name, choices, threshold).select(
        F.col("value").alias("__v"), F.col("match").alias("__m"))
    j = df.join(m, df[f"`{name}`"].cast("string") == F.col("__v"), "left")
    return j.select(*[F.coalesce(F.col("__m"), df[f"`{c}`"].cast("string")).alias(c) if c == name
                      else df[f"`{c}`"] for c in df.columns])
