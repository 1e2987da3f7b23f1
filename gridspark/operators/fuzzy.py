"""Fuzzy match against a reference table (Q3, F18 for tables of any size).

The score is that of ``similarity``: 100 * (1 - levenshtein / longer length) on
lower-cased text. A score of at least ``threshold`` allows at most
d = (1 - threshold / 100) * longer length edits, and an edit destroys at most q of
a text's q-grams (padded at both ends). Pairs are therefore looked up in an
inverted index of q-grams with three filters, none of which loses a pair:

* prefix: with the grams of a text in one global order, rare ones first, the first
  q * d + 1 grams of two texts within d edits have a gram in common (grams equal to
  the last of them are taken along);
* position: that gram stands at most d places apart in the two;
* length: the shorter length is at least threshold percent of the longer. It is
  part of the join key, so that the list of a frequent gram is cut by length.

What the index finds is verified where it is found, by an edit distance that stops
at d, and then with the score itself. Everything is a join of
distinct values; no list is inlined, sent to all tasks or compared in all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column
from gridspark.functions.core import similarity
from gridspark.functions.names import plain_names, quoted
from gridspark.plans.ordered import default_buckets

_EPS = 1e-9


def gram_size(threshold: float) -> int:
    """The longest q-gram of which d edits cannot destroy all: q * (1 - t) <= 1."""
    return max(q for q in (1, 2, 3) if q * (1 - threshold / 100) <= 1 or q == 1)


def _allowed(length: Column, threshold: float) -> Column:
    """Most edits between texts of which the longer has ``length`` characters."""
    return F.floor(length * (1 - threshold / 100) + _EPS).cast("int")


def _longest_partner(length: Column, threshold: float) -> Column:
    return F.floor(length / (threshold / 100) + _EPS).cast("int")


def _values(df: DataFrame, column: str, name: str) -> DataFrame:
    v = quoted(column).cast("string")
    return df.where(v.isNotNull()).groupBy(v.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """(low, length, gram, at): the padded q-grams of each text with their places."""
    padded = F.concat(F.repeat(F.lit("\x02"), q - 1), "low", F.repeat(F.lit("\x03"), q - 1)) if q > 1 else F.col("low")
    n = F.length(padded) - (q - 1)
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                      lambda i: F.struct(F.substring(padded, i, F.lit(q)).alias("gram"), i.alias("at"))))
    none = F.array(F.struct(F.lit("").alias("gram"), F.lit(1).alias("at")))     # the empty text meets itself
    return texts.select("low", F.length("low").alias("length"), F.inline(F.coalesce(grams, none)))


def _prefixes(texts: DataFrame, frequency: DataFrame, q: int, threshold: float) -> DataFrame:
    """The grams of ``_grams`` that stand in the text's prefix."""
    rows = _grams(texts, q).join(frequency, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # rank() counts equal grams as one place, so all grams equal to the last one are kept
    place = F.rank().over(Window.partitionBy("low").orderBy("n", "gram"))
    most = q * _allowed(_longest_partner(F.col("length"), threshold), threshold) + 1
    return rows.withColumn("place", place).where(F.col("place") <= most).select("low", "length", "gram", "at")


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(a, b, score): all pairs of a text of ``left`` and one of ``right`` (one column
    ``low`` each: distinct lower-case texts) whose score is at least ``threshold``."""
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be above 0 and at most 100")
    q = gram_size(threshold)
    # any order of grams gives all pairs; the reference's frequencies make lists short
    frequency = _grams(right, q).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    a = _prefixes(left, frequency, q, threshold).select(
        F.col("low").alias("a"), F.col("length").alias("la"), "gram", F.col("at").alias("at_a"))
    b = _prefixes(right, frequency, q, threshold).select(
        F.col("low").alias("b"), F.col("length").alias("lb"), "gram", F.col("at").alias("at_b"))
    shortest = F.ceil(F.col("lb") * (threshold / 100) - _EPS).cast("int")
    b = b.withColumn("la", F.explode(F.sequence(shortest, _longest_partner(F.col("lb"), threshold))))
    most = _allowed(F.greatest(F.col("la"), F.col("lb")), threshold)
    # pairs too far apart go where they meet, so only true pairs are shuffled
    near = (F.abs(F.col("at_a") - F.col("at_b")) <= most) & (
        F.call_function("levenshtein", F.col("a"), F.col("b"), most) >= 0)
    # few bytes make many pairs here: a fixed number of partitions is not coalesced by size
    n = default_buckets(left)
    a, b = a.repartition(n, "gram", "la"), b.repartition(n, "gram", "la")
    met = a.join(b, ["gram", "la"]).where(near).select("a", "b").distinct()
    return met.withColumn("score", similarity("a", "b")).where(F.col("score") >= threshold)


def fuzzy_join_table(left: DataFrame, left_column, right: DataFrame, right_column, threshold: float = 80.0,
                     best: bool = True) -> DataFrame:
    """Q3 against a table: (value, match, score, count) for the distinct non-null values
    of ``left_column`` (as text) and of ``right_column``; ``count`` is the value's rows.

    With ``best`` one row per value: its closest reference value (ties to the smallest),
    null match and score below ``threshold``. Otherwise every pair that reaches it."""
    values = _values(left, resolve_column(left_column, left.columns), "value")
    refs = _values(right, resolve_column(right_column, right.columns), "match").drop("count")
    values, refs = values.withColumn("low", F.lower("value")), refs.withColumn("low", F.lower("match"))
    pairs = fuzzy_pairs(values.select("low").distinct(), refs.select("low").distinct(), threshold)
    named = pairs.join(refs.withColumnRenamed("low", "b"), "b")
    if not best:
        return values.join(named.withColumnRenamed("a", "low"), "low").select("value", "match", "score", "count")
    top = named.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("m"))
    return values.join(top.withColumnRenamed("a", "low"), "low", "left").select(
        "value", F.col("m.match").alias("match"), (-F.col("m.s")).alias("score"), "count")


def fuzzy_replace_from(df: DataFrame, column, right: DataFrame, right_column, threshold: float = 80.0) -> DataFrame:
    """Q3 applied: each value of ``column`` becomes its closest reference value when the
    score reaches ``threshold`` (others stay)."""
    name = resolve_column(column, df.columns)
    found = fuzzy_join_table(df, name, right, right_column, threshold).where("match is not null").select(
        F.col("value").alias("_value"), F.col("match").alias("_match"))
    frame, to = plain_names(df)
    joined = frame.join(found, F.col(to[name]).cast("string") == F.col("_value"), "left")
    return joined.select(*[(F.coalesce("_match", F.col(to[c]).cast("string")) if c == name else F.col(to[c])).alias(c)
                           for c in df.columns])


def filter_fuzzy_table(df: DataFrame, column, right: DataFrame, right_column, threshold: float = 80.0) -> DataFrame:
    """F18 against a table: rows whose value comes within ``threshold`` of any reference value."""
    name = resolve_column(column, df.columns)
    hits = fuzzy_join_table(df, name, right, right_column, threshold).where("match is not null").select(
        F.col("value").alias("_value"))
    frame, to = plain_names(df)
    return frame.join(hits, F.col(to[name]).cast("string") == F.col("_value"), "left_semi").toDF(*df.columns)
