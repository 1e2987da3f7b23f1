"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

For each anchor two searches run: its best rows of the same label (positives), then,
for each positive, the best rows of other labels whose score lies in a window below
the positive's. A search is a threshold join. Dimensions are put in order of the rows'
energy and cut into strips; the index lists, strip by strip, the rows that have to be
looked at there: a row's last strips are left out when no anchor can reach its threshold
over them alone (product of the suffix norms). Partial scores are accumulated along
the lists, a row is dropped as soon as partial score plus the product of the remaining
norms is under every anchor's threshold, and pairs that are left get their exact score.
Thresholds start high; anchors whose windows are not full go on with a lower one,
until they are full or the window's lower end is reached.

Anchors meet rows in cells of at most ``ANCHOR_BLOCK`` by ``ROW_BLOCK``; a cell sends
on at most as many rows for each window as the window may return.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.llm.common import ship_code, written

ANCHOR_BLOCK = 512
ROW_BLOCK = 8192
STRIP = 16          # dimensions of one list of the index
LABEL_BUCKETS = 64  # cells of the search within labels hold one bucket of labels
PAIRS = 1 << 16     # exact scores computed at once
_ENTRY = "id long, h long, w int, c long, ch long, s long"


def labelled_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v, h): distinct rows that take part, ``v`` as floor(scale * x) in
    double precision, ``h`` telling rows of one id apart."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = F.when(size < 2.0 ** 62, v.cast("array<bigint>")).otherwise(
        F.raise_error(F.lit("a vector's squared length is 2^62 or more: scores are no longs")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                           F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(~bad)
            .select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))
            .select("id", "label", whole.alias("v")).distinct()
            .withColumn("h", F.xxhash64("label", "v")))


def reaching(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): all pairs of a row of ``x`` and one of ``y`` (integers) whose inner
    product is at least ``t[i]``."""
    d = x.shape[1]
    order = np.argsort(-(y.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    a, b = x[:, order].astype(np.float64), y[:, order].astype(np.float64)
    cuts = [*range(0, d, STRIP), d]
    # norms of what is left from each cut on
    rest_a, rest_b = (np.sqrt(np.stack([(m[:, c:] ** 2).sum(axis=1) for c in cuts])) for m in (a, b))
    least = t - 1e-6 - 1e-12 * (d + 1) * rest_a[0] * rest_b[0].max(initial=0)     # room for rounding
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(least[None] > 0, least[None] / rest_a, 0.0)
    needed = np.nan_to_num(needed, nan=0.0, posinf=np.inf).min(axis=1, initial=np.inf)
    strips = np.minimum.accumulate(rest_b[:-1] >= needed[:-1, None], axis=0).sum(axis=0)   # strips a row is listed in
    rows = np.argsort(-strips, kind="stable")
    rows = rows[strips[rows] > 0] if d else rows
    score = np.zeros((len(a), len(rows)))
    for c in range(len(cuts) - 1 if d else 0):
        n = int((strips[rows] > c).sum())      # the list of this strip: rows come by falling number of strips
        if not n:
            break
        score[:, :n] += a[:, cuts[c]:cuts[c + 1]] @ b[rows[:n], cuts[c]:cuts[c + 1]].T
        alive = (score[:, :n] + rest_a[c + 1][:, None] * rest_b[c + 1, rows[:n]] >= least[:, None]).any(axis=0)
        if not alive.all():
            keep = np.append(np.flatnonzero(alive), np.arange(n, len(rows)))
            rows, score = rows[keep], score[:, keep]
    end = strips[rows]
    i, j = np.nonzero(score + rest_a.T[:, end] * rest_b[end, rows] >= least[:, None])
    j = rows[j]
    exact = np.empty(len(i), dtype=np.int64)
    for k in range(0, len(i), PAIRS):
        exact[k:k + PAIRS] = np.einsum("nd,nd->n", x[i[k:k + PAIRS]], y[j[k:k + PAIRS]])
    ok = exact >= t[i]
    return i[ok], j[ok], exact[ok]


def _first(groups: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Indices of the first ``k`` of each group, by ``order``."""
    by = np.lexsort((*order[::-1], *groups[::-1]))
    if not len(by):
        return by
    new = np.append(True, np.any([g[by][1:] != g[by][:-1] for g in groups], axis=0))
    place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return by[place < k]


def _cell(left: pd.DataFrame, right: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The first ``k`` rows of this cell for each window of its anchors, of those that
    reach the anchor's threshold."""
    columns = ["id", "h", "w", "c", "ch", "s"]
    if not len(left) or not len(right):
        return pd.DataFrame(columns=columns).astype("int64")
    x, y = (np.array(df["v"].tolist(), dtype=np.int64).reshape(len(df), -1) for df in (left, right))
    i, j, s = reaching(x, y, left["t"].to_numpy(dtype=np.float64))
    ids, hashes, found, rows = left["id"].to_numpy(), left["h"].to_numpy(), right["id"].to_numpy(), right["h"].to_numpy()
    both, number = pd.factorize(pd.concat((left["label"], right["label"])))[0], len(left)
    ok = (ids[i] != found[j]) & ((both[:number][i] == both[number:][j]) == same)
    i, j, s = i[ok], j[ok], s[ok]
    out = []
    for w in range(int(left["lows"].map(len).max())):
        low, high = (np.array([b[w] if w < len(b) else none for b in left[c]], dtype=np.int64)
                     for c, none in (("lows", 1), ("highs", 0)))
        inside = (s >= low[i]) & (s <= high[i])
        a, b, v = i[inside], j[inside], s[inside]
        n = _first((a,), (-v, found[b], rows[b]), k)
        out.append(np.column_stack((ids[a[n]], hashes[a[n]], np.full(len(n), w), found[b[n]], rows[b[n]], v[n])))
    return pd.DataFrame(np.concatenate(out), columns=columns)


def _blocks(df: DataFrame, most: int) -> int:
    return max(1, -(-df.count() // most))


def _filled(anchors: DataFrame, rows: DataFrame, k: int, same: bool, thresholds: list[Column],
            name: str) -> DataFrame:
    """(id, h, w, c, ch, s): the first ``k`` rows for each window of each anchor (columns
    id, h, label, v, lows, highs). An anchor is asked with one threshold after the other
    until each window is full or lies above the threshold altogether."""
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)) if same else F.lit(0).cast("long")
    row_blocks = _blocks(rows, ROW_BLOCK)
    place = Window.partitionBy("id", "h", "w").orderBy(F.desc("s"), "c", "ch")
    done, open_ = [], anchors
    for turn, threshold in enumerate(thresholds):
        asked = open_.withColumn("t", threshold.cast("double"))
        blocks = _blocks(asked, ANCHOR_BLOCK)

        def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
            return (df.withColumn("g", bucket).withColumn("dim", F.size("v"))
                    .withColumn(own, F.pmod(F.xxhash64("id", "h"), F.lit(n_own)).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))
        cell = ["g", "dim", "ab", "rb"]
        found = (dealt(asked, "ab", blocks, "rb", row_blocks).groupBy(*cell)
                 .cogroup(dealt(rows, "rb", row_blocks, "ab", blocks).groupBy(*cell))
                 .applyInPandas(partial(_cell, k=k, same=same), _ENTRY))
        found = written(found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).drop("n"),
                        f"{name}-{turn}")
        if turn + 1 == len(thresholds):
            done.append(found)
            break
        full = found.groupBy("id", "h", "w").count().where(F.col("count") == k).groupBy("id", "h").agg(
            F.collect_set("w").alias("full"))
        state = written(asked.join(full, ["id", "h"], "left").withColumn("ready", F.forall(
            F.sequence(F.lit(0), F.size("lows") - 1),
            lambda w: F.coalesce(F.array_contains("full", w), F.lit(False)) | (F.get("lows", w) >= F.col("t"))
            | (F.get("lows", w) > F.get("highs", w)))).drop("full", "t"), f"{name}-state-{turn}")
        done.append(found.join(state.where("ready").select("id", "h"), ["id", "h"], "left_semi"))
        open_ = state.where(~F.col("ready")).drop("ready")
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): anchors
    are the rows whose id is divisible by ``anchor_every``, their positives the first
    ``positives`` other rows of the same label; for each, the first ``negatives`` rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score
    (percentages, 0 to 100). Scores are inner products of floor(scale * x); higher scores come
    first, then smaller ids.

    Defined cases: rows with a null id or label, or a vector that is null or holds a null
    or non-finite component, take no part; only vectors of one length are compared;
    rows equal in id, label and vector are one; rows of one id that differ otherwise are
    rows of their own, as anchors each asked for itself, but never each other's positive or
    negative; a positive of negative score has no window; a squared length of 2^62 or more
    (after scaling) raises; extra columns are ignored; an empty table gives no rows.

    Scale: a fixed share of the rows are anchors, so the work is quadratic in the rows, as
    it is for any exact search; the bounds prune rows and strips of it. No task
    holds more than one cell, and nothing is sent to all tasks or to the driver but counts
    and one norm."""
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are percentages with low <= high")
    ship_code(vectors.sparkSession)
    rows = written(labelled_vectors(vectors, id_col, vec_col, label_col, scale), "negatives-vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = rows.agg(F.max(length)).first()[0] or 0.0
    anchors = rows.where(F.col("id") % anchor_every == 0)
    far = 1 << 62
    wide = anchors.withColumn("lows", F.array(F.lit(-far))).withColumn("highs", F.array(F.lit(far)))
    best = _filled(wide, rows, positives, True,
                   [length * longest * 0.5, length * longest * 0.25, F.lit(float("-inf"))], "negatives-positives")
    told = best.groupBy("id", "h").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("s")).alias("s"), "c", "ch"))).alias("p"))     # at most ``positives`` entries
    asked = written(anchors.join(told, ["id", "h"]).withColumn("p", F.transform(
        "p", lambda e: F.struct((-e["s"]).alias("s"), e["c"].alias("c")))), "negatives-anchors")
    # score * percent / 100, rounded up and down without leaving the longs; an empty window under a negative score
    share = "transform(p, e -> if(e.s < 0, {0}L, (e.s div 100) * {1} + ((e.s % 100) * {1} + {2}) div 100))"
    asked = (asked.withColumn("lows", F.expr(share.format(1, low, 99)))
             .withColumn("highs", F.expr(share.format(0, high, 0))))
    lowest = F.array_min("lows")
    found = _filled(asked, rows, negatives, False,
                    [lowest + (F.array_min("highs") - lowest) / 2, lowest], "negatives-found")
    place = Window.partitionBy("id", "h", "w").orderBy(F.desc("s"), "c", "ch")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
            .join(asked.select("id", "h", "p"), ["id", "h"]).withColumn("e", F.get("p", F.col("w")))
            .select(F.col("id").alias("anchor_id"), F.col("e.c").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("c").alias("negative_id"), F.col("e.s").alias("positive_score"), F.col("s").alias("negative_score")))
