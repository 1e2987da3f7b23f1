"""Correlations of wide tables by blocks of Gram sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_columns
from gridspark.functions.names import plain_names
from gridspark.operators.aggregate import numeric_columns

BLOCK = 256     # columns of a block; a task holds five sums for each pair of two blocks
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "odd")
_FLAT = 1e-12   # share of the squares below which a variance is rounding only


def _gram(left: list[int], right: list[int], centre: list[float], same: bool):
    """A task's sums over the rows in which both columns of a pair are present."""
    columns = sorted({*left, *right})
    at = {c: i for i, c in enumerate(columns)}
    a, b = [at[c] for c in left], [at[c] for c in right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                                 for i in range(len(columns))])
            m = np.column_stack([batch.column(i).is_valid().to_numpy(zero_copy_only=False)
                                 for i in range(len(columns))]).astype(np.float64)
            x -= np.array([centre[c] for c in columns])
            odd = ~np.isfinite(x)
            bad = (odd & (m > 0)).astype(np.float64)
            x[odd] = 0.0
            xa, xb, ma, mb = x[:, a], x[:, b], m[:, a], m[:, b]
            sums = [ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb,
                    bad[:, a].T @ mb + ma.T @ bad[:, b]]
            total = sums if total is None else [p + q for p, q in zip(total, sums)]
        if total is not None:
            i, j = np.triu_indices(len(left)) if same else np.indices((len(left), len(right))).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(left)[i], pa.int32()), pa.array(np.array(right)[j], pa.int32()),
                 *[pa.array(s[i, j]) for s in total]], names=["i", "j", *_SUMS])

    return run


def corr_pairs(df: DataFrame, columns: Sequence | None = None, block: int = BLOCK) -> DataFrame:
    """A15 for many columns: ``a``, ``b`` (each pair once, in column order, a column
    with itself included), ``n`` (rows with both present) and ``corr``, Pearson's
    correlation over these rows. ``corr_matrix`` gives the same numbers as a table as
    wide as its input, from an aggregate with an expression for each pair.

    Null where a column is constant over the rows or ``n`` is under 2; NaN where a row
    of the pair holds NaN or an infinity.

    One read gives the columns' means, which centre the values; then each pair of
    blocks of columns is one read of these columns only, in which a task adds up seven
    products of matrices. A task sends one row for each pair, whatever it has read, so
    for wide tables ``spark.sql.files.maxPartitionBytes`` should be large against
    64 bytes a pair. The driver reads one row of means."""
    if block < 1:
        raise ValueError("block must be at least 1")
    names = resolve_columns(columns, df.columns) if columns else numeric_columns(df)
    if not names:
        raise ValueError("no numeric column")
    plain, to = plain_names(df)
    plain = plain.select(*[F.col(to[c]).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)  # noqa: E731  (NaN counts as greater)
    means = plain.agg(*[F.avg(finite(F.col(c))).alias(c) for c in plain.columns]).first()
    centre = [m if m is not None and np.isfinite(m) else 0.0 for m in means]
    starts = range(0, len(names), block)
    parts = None
    for lo in starts:
        for hi in (s for s in starts if s >= lo):
            left, right = (list(range(s, min(s + block, len(names)))) for s in (lo, hi))
            part = plain.select(*[f"c{i}" for i in sorted({*left, *right})]).mapInArrow(
                _gram(left, right, centre, lo == hi), "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
            parts = part if parts is None else parts.unionByName(part)
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    vx, vy = (F.col("n") * F.col(f"s{c * 2}") - F.col(f"s{c}") * F.col(f"s{c}") for c in "xy")
    some = lambda v, c: v > _FLAT * F.col("n") * F.col(f"s{c * 2}")
    corr = (F.when(F.col("odd") > 0, F.lit(float("nan")))
            .when(some(vx, "x") & some(vy, "y") & (F.col("n") > 1),
                  F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
                      (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy)))))
    label = F.lit(list(names))
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("i"))
    pairs = every.select("i", F.explode(F.sequence("i", F.lit(len(names) - 1))).alias("j"))
    return pairs.join(s.select("i", "j", "n", corr.alias("corr")), ["i", "j"], "left").select(
        F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"),
        F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n"), "corr")
