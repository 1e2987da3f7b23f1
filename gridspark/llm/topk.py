"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are split into a few lists; a list knows only its
own part of each score. Phase 1 gathers every list's local top entries; the
exact scores of those give, for each query, a cutoff that k candidates reach. Phase 2
sends the cutoff to all lists: a candidate that reaches it must have at least
an equal share of it in one list, and each list sends all its entries that do.
Phase 3 resolves the exact scores of the entries sent. Work is done on blocks of
queries against blocks of candidates, of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridspark.llm.common import ship_code, written

QUERY_BLOCK = 512
ROW_BLOCK = 8192
DEPTH = 16     # a local list is this many times k long: the longer, the higher the cutoff
_INT = "array<bigint>"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): components as floor(scale * x) in double precision; vectors that
    are null or hold a null or non-finite component are left out."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull()).where(~bad)
            .select("id", F.transform("v", lambda x: F.floor(x * scale)).cast(_INT).alias("v")))


def _blocks(df: DataFrame, rows_a_block: int) -> tuple[DataFrame, int]:
    """``df`` with a block number; blocks hold about ``rows_a_block`` rows."""
    n = max(1, -(-df.count() // rows_a_block))
    return df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _cells(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, lists: int):
    """Queries and candidates dealt to (query block, candidate block, list)."""
    def dealt(df: DataFrame, own: str, other: str, n_other: int) -> DataFrame:
        size = F.size("v")
        part = F.slice("v", F.floor(size * F.col("part") / lists).cast("int") + 1,
                       (F.floor(size * (F.col("part") + 1) / lists) - F.floor(size * F.col("part") / lists)).cast("int"))
        rest = [c for c in df.columns if c not in ("block", "v")]
        total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
        own_part = F.aggregate("pv", F.lit(0).cast("long"), lambda s, x: s + x * x)
        return (df.withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
                .withColumn("pv", part).withColumn("rest", F.sqrt((total - own_part).cast("double")))
                .withColumn("dim", size).select("qb", "rb", "part", "dim", "pv", "rest", *rest))
    left = dealt(queries, "qb", "rb", n_rows).groupBy("qb", "rb", "part", "dim")
    return left.cogroup(dealt(rows, "rb", "qb", n_queries).groupBy("qb", "rb", "part", "dim"))


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: int = 256, lists: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``query_every`` its ``k`` highest integer inner products with all other rows
    (all, if fewer), ties to the smaller id, ranks from 1.

    Defined cases: vectors that are null or hold a null or non-finite component
    take no part, nor do rows with a null id; an empty vector is a vector of no
    components; only vectors of one length are compared; rows with one id are one
    candidate for each distinct vector and such a query is asked once for each;
    a row is its own candidate never (by id); extra columns are ignored; an empty
    table gives no rows.

    Scale: candidates and queries are dealt to cells of bounded size (blocks of
    ``ROW_BLOCK`` by ``QUERY_BLOCK`` rows), so no task and no broadcast grows with
    the data; only local top lists, entries over the cutoff and their exact
    scores are shuffled after that."""
    ship_code(vectors.sparkSession)
    kept = written(quantised(vectors, id_col, vec_col, scale).distinct(), "topk-vectors")
    asked = kept.where(F.col("id") % query_every == 0)
    # equal vectors score alike, so only the k + 1 smallest ids of each can be among
    # any query's k best (one may be the query itself)
    alike = Window.partitionBy("v").orderBy("id")
    rows = written(kept.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n"),
                   "topk-candidates")
    rows_b, n_rows = _blocks(rows, ROW_BLOCK)
    asked_b, n_queries = _blocks(asked, QUERY_BLOCK)
    asked_b = asked_b.withColumn("qh", F.xxhash64("v"))
    rows_b = rows_b.withColumn("rh", F.xxhash64("v"))

    def local_top(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "qh": [], "c": [], "rh": [], "p": [], "part": []}).astype("int64")
        score = _matrix(left.pv).reshape(len(left), -1) @ _matrix(right.pv).reshape(len(right), -1).T
        order = np.argsort(right.id.to_numpy(), kind="stable")
        score, ids, hashes = score[:, order], right.id.to_numpy()[order], right.rh.to_numpy()[order]
        score[left.id.to_numpy()[:, None] == ids[None]] = -np.inf
        n = min(k * DEPTH, score.shape[1])
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        part = np.take_along_axis(score, best, 1)
        ok = np.isfinite(part).ravel()
        return pd.DataFrame({"q": np.repeat(left.id.to_numpy(), n)[ok], "qh": np.repeat(left.qh.to_numpy(), n)[ok],
                             "c": ids[best].ravel()[ok], "rh": hashes[best].ravel()[ok],
                             "p": part.ravel()[ok].astype("int64"), "part": left.part.iloc[0]}).astype("int64")

    found = _cells(asked_b, rows_b, n_queries, n_rows, lists).applyInPandas(
        local_top, "q long, qh long, c long, rh long, p long, part long")
    first = Window.partitionBy("q", "qh", "part").orderBy(F.desc("p"), "c", "rh")
    local = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k * DEPTH).select(
        "q", "qh", "c", "rh").distinct()

    def exact(pairs: DataFrame) -> DataFrame:
        one = asked.select(F.col("id").alias("q"), F.xxhash64("v").alias("qh"), F.col("v").alias("qv"))
        two = rows.select(F.col("id").alias("c"), F.xxhash64("v").alias("rh"), F.col("v").alias("cv"))
        score = F.aggregate(F.zip_with("qv", "cv", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        return pairs.join(two, ["c", "rh"]).join(one, ["q", "qh"]).select("q", "qh", "c", "rh", score.alias("score"))

    ranked = Window.partitionBy("q", "qh").orderBy(F.desc("score"), "c", "rh")
    cutoff = (exact(local).withColumn("n", F.row_number().over(ranked)).groupBy("q", "qh")
              .agg(F.min(F.when(F.col("n") == k, F.col("score"))).alias("cutoff")))
    told = written(asked_b.join(cutoff.select(F.col("q").alias("id"), "qh", "cutoff"), ["id", "qh"], "left"),
                   "topk-cutoffs")

    def sufficient(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "qh": [], "c": [], "rh": []}).astype("int64")
        out, cand = [], _matrix(right.pv).reshape(len(right), -1).T
        cut = left.cutoff.astype("float64").fillna(-np.inf).to_numpy()[:, None]
        score = _matrix(left.pv).reshape(len(left), -1) @ cand
        # its equal share here, and the cutoff within reach of what is left (Cauchy-Schwarz, rounded up)
        reach = score + left["rest"].to_numpy()[:, None] * right["rest"].to_numpy()[None] * (1 + 1e-9) + 1e-3
        take = (score * lists >= cut) & (reach >= cut) & (left.id.to_numpy()[:, None] != right.id.to_numpy()[None])
        i, j = np.nonzero(take)
        return pd.DataFrame({"q": left.id.to_numpy()[i], "qh": left.qh.to_numpy()[i],
                             "c": right.id.to_numpy()[j], "rh": right.rh.to_numpy()[j]})

    sent = _cells(told, rows_b, n_queries, n_rows, lists).applyInPandas(
        sufficient, "q long, qh long, c long, rh long").distinct()
    return (exact(sent).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("c").alias(id_col), "score"))
