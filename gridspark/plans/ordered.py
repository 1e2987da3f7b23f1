"""Order statistics without a single-task window.

A plain ``Window.orderBy(k)`` (no partition) or a window over one huge group
sends every row of that group to one task. The helpers here keep every step
bounded instead:

1. ``groupBy(by, keys).count()`` collapses repeated values with a map-side
   partial aggregate (a hot key becomes one row per map task).
2. The distinct rows are range-partitioned on ``(by, keys)``
   (``repartitionByRange``), so each bucket is a contiguous slice of the sort
   order and equal keys share a bucket.
3. Running counts are computed inside each ``(bucket, group)`` slice, and a
   tiny table of per-slice totals (at most buckets + groups rows) turns them
   into offsets.

Exact quantiles of large groups need less: ``bracketed_quantiles`` brackets the wanted
ranks with a sketch and then keeps the values inside the brackets only.

From the resulting *position table* come every tie method of rank (min, max,
average, dense, percentile), exact quantiles with linear interpolation, and
row numbering. Results are exact; nothing is sampled or capped.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import scratch_path

OrderSpec = Sequence  # of column names or (name, ascending) pairs


def _norm_order(order) -> list[tuple[str, bool]]:
    if isinstance(order, str):
        return [(order, True)]
    out = []
    for o in order:
        if isinstance(o, str):
            out.append((o, True))
        else:
            out.append((o[0], bool(o[1])))
    return out


def default_buckets(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(1, int(conf))


SINGLE_TASK_ROWS = 2_000_000
STRATEGIES = ("auto", "window", "positions")


def single_task_rows(df: DataFrame) -> int:
    """Largest group a single task may order (``gridspark.singleTaskRows``)."""
    return int(df.sparkSession.conf.get("gridspark.singleTaskRows", str(SINGLE_TASK_ROWS)))


def largest_group(df: DataFrame, by: Sequence[str], not_null: Sequence[str]) -> int:
    """Rows in the largest group (one aggregation; returns one number)."""
    base = df
    for c in not_null:
        base = base.where(F.col(f"`{c}`").isNotNull())
    if not by:
        return base.count()
    top = base.groupBy(*[F.col(f"`{b}`") for b in by]).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def choose_strategy(df: DataFrame, strategy: str, by: Sequence[str], not_null: Sequence[str]) -> str:
    """A plain window when the largest group is proven to fit one task (checked
    with one aggregation), else the bucketed position table, whose windows run
    over slices of the order. ``window`` is checked like ``auto``, so no task
    ever orders a larger group."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {STRATEGIES}")
    if strategy == "positions":
        return strategy
    return "window" if largest_group(df, by, not_null) <= single_task_rows(df) else "positions"


def _order_is_reproducible(df: DataFrame) -> bool:
    """True when recomputing ``df`` yields its rows in the same partitions and
    order (file scans, filters, projections: no shuffle in the plan)."""
    try:
        return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    except Exception:  # noqa: BLE001 - plan not inspectable: assume it is not
        return False


def materialize(df: DataFrame, name: str = "gridspark", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: the lineage is cut, so every
    later branch sees exactly the same rows, even after executor loss. The
    folder goes when the application ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating null = null (``<=>``), keeping one copy of
    each key column."""
    keys = list(keys)
    if not keys:
        return _scalar_join(left, right)
    r = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in keys else F.col(f"`{c}`")
                       for c in right.columns])
    cond = [left[f"`{k}`"].eqNullSafe(r[f"`__r_{k}`"]) for k in keys]
    return left.join(r, on=cond, how=how).drop(*[f"__r_{k}" for k in keys])


def _scalar_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row of ``left`` as
    scalar subqueries (no join, the values are broadcast as constants)."""
    row = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns])).scalar()
    return left.select("*", *[row[c].alias(c) for c in right.columns])


def order_key(columns: Sequence[str]) -> Column:
    """A struct that sorts like ``columns`` ascending with nulls last (for
    ``min``, ``max``, ``min_by`` and ``max_by``)."""
    return F.struct(*[x for i, c in enumerate(columns) for x in (
        F.col(f"`{c}`").isNull().alias(f"_null{i}"), F.col(f"`{c}`").alias(f"_key{i}"))])


def sort_order(order) -> list[Column]:
    """Sort columns of an order, nulls last in either direction."""
    return [F.col(f"`{k}`").asc_nulls_last() if asc else F.col(f"`{k}`").desc_nulls_last()
            for k, asc in _norm_order(order)]


def range_buckets(df: DataFrame, order, by: Sequence[str] = (), n_buckets: int | None = None,
                  bucket: str = "_b", row_id: str = "_uid") -> DataFrame:
    """``df`` written in contiguous slices of the order ``(by, order, row id)``,
    with its slice number and row id. The row id splits rows that are equal in
    every order key, so no slice depends on how often a key repeats; the written
    table fixes both numbers for every later branch of a plan."""
    nb = n_buckets or default_buckets(df)
    tagged = df.withColumn(row_id, F.monotonically_increasing_id())
    cut = tagged.repartitionByRange(
        nb, *[F.col(f"`{b}`").asc() for b in by], *sort_order(order), F.col(row_id).asc())
    return materialize(cut.withColumn(bucket, F.spark_partition_id()), "buckets", [bucket])


def positions(df: DataFrame, order, by: Sequence[str] = (), n_buckets: int | None = None,
              null_groups: bool = False, null_keys: bool = False) -> DataFrame:
    """Position table: one row per distinct ``(by, order keys)`` with

    * ``_n``       rows holding this key
    * ``_before``  rows of the same group strictly before it in the order
    * ``_dense``   1-based index of the key among the group's distinct keys
    * ``_total``   non-null rows in the group
    * ``_ndist``   distinct keys in the group

    Rows whose order key is null are left out (they rank null) unless
    ``null_keys`` (nulls then sort last); so are rows of a null group unless
    ``null_groups`` (aggregations keep null groups).
    """
    order = _norm_order(order)
    by = list(by)
    keys = [k for k, _ in order]
    nb = n_buckets or default_buckets(df)
    cols = by + keys
    base = df.select(*[F.col(f"`{c}`") for c in cols])
    for c in ([] if null_groups else by) + ([] if null_keys else keys):
        base = base.where(F.col(f"`{c}`").isNotNull())
    counts = base.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_n"))

    sort_cols = [F.col(f"`{b}`").asc() for b in by] + sort_order(order)
    bucketed = counts.repartitionByRange(nb, *sort_cols).withColumn("_b", F.spark_partition_id())

    part = ["_b"] + by
    w = Window.partitionBy(*part).orderBy(*sort_order(order))
    # bucket ids come from the range exchange, which Spark shares between the
    # two branches joined below. As a guard, each slice's key count and key
    # checksum (xor of key hashes) from the offsets branch must agree with
    # the running count / checksum of the same slice here; if the buckets
    # ever differed, the query fails instead of returning wrong positions.
    key_hash = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    local = bucketed.select(
        "*",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lb"),
        F.row_number().over(w).alias("_ld"),
        F.bit_xor(key_hash).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_lx"))

    # per (bucket, group) totals: at most n_buckets + n_groups rows
    slices = local.groupBy(*part).agg(F.sum("_n").alias("_sn"), F.count(F.lit(1)).alias("_sd"),
                                      F.bit_xor(key_hash).alias("_sh"))
    wg = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    prior = Window.partitionBy(*by) if by else Window.partitionBy()
    offsets = slices.select(
        *part,
        F.coalesce(F.sum("_sn").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ob"),
        F.coalesce(F.sum("_sd").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_od"),
        F.sum("_sn").over(prior).alias("_total"),
        F.sum("_sd").over(prior).alias("_ndist"), "_sd", "_sh")

    joined = null_safe_join(local, offsets, part) if null_groups else local.join(
        offsets, on=part, how="inner")
    # the guard is attached to every output derived from the offsets, so the
    # optimizer cannot prune it away whichever of them a caller uses
    same_slice = (F.col("_ld") <= F.col("_sd")) & (
        (F.col("_ld") != F.col("_sd")) | (F.col("_lx") == F.col("_sh")))

    def guarded(c):
        return F.when(same_slice, c).otherwise(
            F.raise_error(F.lit("gridspark: range buckets disagree between plan branches")).cast("long"))

    return joined.select(
        *[F.col(f"`{c}`") for c in cols], guarded(F.col("_n")).alias("_n"),
        guarded(F.col("_ob") + F.col("_lb")).alias("_before"),
        guarded(F.col("_od") + F.col("_ld")).alias("_dense"),
        "_total", "_ndist")


RANK_METHODS = ("min", "max", "average", "first", "dense", "percentile")


def rank_expr(method: str) -> Column:
    """Rank of a position-table row by tie method (not 'first')."""
    lo = F.col("_before") + 1
    hi = F.col("_before") + F.col("_n")
    if method == "min":
        return lo
    if method == "max":
        return hi
    if method == "average":
        return (lo + hi) / F.lit(2.0)
    if method == "dense":
        return F.col("_dense")
    if method == "percentile":
        return ((lo + hi) / F.lit(2.0)) / F.col("_total")
    raise ValueError(f"unknown rank method {method!r}; choose from {RANK_METHODS}")


def _numbered_rows(df: DataFrame, not_null: Sequence[str]) -> tuple[DataFrame, Column]:
    """``df`` with ``_alone``, null for the rows that a window numbers and a value
    of its own for each of the others (null in one of ``not_null``), so that those
    never meet in one window partition."""
    valid = F.lit(True)
    for c in not_null:
        valid = valid & F.col(f"`{c}`").isNotNull()
    return df.withColumn("_alone", F.when(~valid, F.monotonically_increasing_id())), F.col("_alone").isNull()


def _window_ranks(df: DataFrame, order, by: list[str], outputs: dict) -> DataFrame:
    plain = df.columns
    df, valid = _numbered_rows(df, by + [k for k, _ in order])
    part = [*[F.col(f"`{b}`") for b in by], F.col("_alone")]
    w = Window.partitionBy(*part).orderBy(*sort_order(order))
    lo = F.rank().over(w)
    hi = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))
    exprs = {"min": lo, "max": hi, "average": (lo + hi) / F.lit(2.0), "dense": F.dense_rank().over(w),
             "percentile": ((lo + hi) / F.lit(2.0)) / F.count(F.lit(1)).over(Window.partitionBy(*part))}
    for m in outputs.values():
        if m not in exprs:
            raise ValueError(f"unknown rank method {m!r}; choose from {RANK_METHODS}")
    return df.select(*[F.col(f"`{c}`") for c in plain],
                     *[F.when(valid, exprs[m]).alias(n) for n, m in outputs.items()])


def attach_ranks(df: DataFrame, order, by: Sequence[str] = (), outputs: dict | None = None,
                 n_buckets: int | None = None, strategy: str = "auto") -> DataFrame:
    """Add rank columns ``{name: method}`` to every row of ``df``; null keys
    or groups rank null. Groups proven small rank with a plain window; else
    the position table is joined back on ``(by, keys)``."""
    order = _norm_order(order)
    keys = [k for k, _ in order]
    by = list(by)
    if choose_strategy(df, strategy, by, by + keys) == "window":
        return _window_ranks(df, order, by, outputs)
    pos = positions(df, order, by, n_buckets)
    pos = pos.select(*[F.col(f"`{c}`") for c in by + keys],
                     *[rank_expr(m).alias(name) for name, m in outputs.items()])
    return df.join(pos, on=by + keys, how="left").select(*[F.col(f"`{c}`") for c in df.columns], *outputs)


def row_numbers(df: DataFrame, order, by: Sequence[str] = (), name: str = "_row",
                n_buckets: int | None = None, strategy: str = "auto", null_keys: bool = False) -> DataFrame:
    """1-based row number in the given order (ordinal rank, R4).

    A hidden row id is appended as the last order key, so rows tied on every
    order column still get distinct numbers (in scan order) and no key group,
    however hot, is numbered inside one task. The id must be the same in the
    two branches of the plan (numbering and joining back), so an input whose
    row order is not reproducible (it contains a shuffle) is first written to
    the shared checkpoint folder. Rows with a null group get a null number, and
    so do rows with a null key unless ``null_keys`` (they are then numbered last).
    """
    by = list(by)
    plain = _norm_order(order)
    not_null = by + ([] if null_keys else [k for k, _ in plain])
    if choose_strategy(df, strategy, by, not_null) == "window":
        rows, valid = _numbered_rows(df, not_null)
        w = Window.partitionBy(*[F.col(f"`{b}`") for b in by], F.col("_alone")).orderBy(*sort_order(plain))
        return rows.withColumn(name, F.when(valid, F.row_number().over(w).cast("long"))).drop("_alone")
    order = plain + [("_uid", True)]
    keys = [k for k, _ in order]
    tagged = df.withColumn("_uid", F.monotonically_increasing_id())
    if not _order_is_reproducible(df):
        tagged = materialize(tagged, "rownumbers")
    pos = positions(tagged, order, by, n_buckets, null_keys=null_keys).select(
        *[F.col(f"`{c}`") for c in by + keys], (F.col("_before") + 1).alias(name))
    out = null_safe_join(tagged, pos, by + keys, how="left") if null_keys else tagged.join(
        pos, on=by + keys, how="left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float], by: Sequence[str] = (),
                    n_buckets: int | None = None, null_groups: bool = False,
                    strategy: str = "auto") -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / ``quantile_cont``).

    Returns ``(by..., q, value)`` with one row per group and requested q. Groups
    that fit one task are sorted there; larger ones are selected within brackets
    (``bracketed_quantiles``), or by the position table where told so. ``strategy``:
    auto or window (both as said), brackets or positions.
    """
    by = list(by)
    not_null = [column] if null_groups else by + [column]
    if strategy in ("auto", "window"):
        rows = largest_group(df, by, not_null)
        if rows <= single_task_rows(df):
            strategy = "window"
        elif df.schema[column].dataType.typeName() == "decimal":
            strategy = "positions"
        else:
            most = min(MOST_ACCURACY, max(ACCURACY, 64 * rows // max(1, single_task_rows(df))))
            return bracketed_quantiles(df, column, qs, by, null_groups, most, n_buckets)
    if strategy == "brackets":
        return bracketed_quantiles(df, column, qs, by, null_groups, n_buckets=n_buckets)
    if strategy == "window" or choose_strategy(df, strategy, by, not_null) == "window":
        # every group is proven to fit one task: sort its values once and
        # interpolate (about twice as fast as Spark's map-based percentile)
        base = df
        for c in not_null:
            base = base.where(F.col(f"`{c}`").isNotNull())
        srt = base.groupBy(*[F.col(f"`{b}`") for b in by]).agg(
            F.array_sort(F.collect_list(F.col(f"`{column}`").cast("double"))).alias("_s")).where(F.size("_s") > 0)
        n = F.size("_s")
        picks = []
        for q in qs:
            p = F.lit(float(q)) * (n - 1)
            lo, hi = F.floor(p), F.ceil(p)
            vlo = F.element_at("_s", (lo + 1).cast("int"))
            vhi = F.element_at("_s", (hi + 1).cast("int"))
            picks.append(F.struct(F.lit(float(q)).alias("q"), (vlo + (vhi - vlo) * (p - lo)).alias("value")))
        return srt.select(*[F.col(f"`{b}`") for b in by], F.inline(F.array(*picks)))
    pos = positions(df, [column], by, n_buckets, null_groups=null_groups)
    return _interpolated(pos.withColumn("_v", F.col(f"`{column}`").cast("double")), qs, by)


def _interpolated(pos: DataFrame, qs: Sequence[float], by: list[str]) -> DataFrame:
    """``(by..., q, value)`` from rows of values (``_v``) with the number of rows before
    them, at them and in their group (``_before``, ``_n``, ``_total``)."""
    hits = _hits(pos, qs, by)
    agg = hits.groupBy(*[F.col(f"`{b}`") for b in by], F.col("h.q").alias("q")).agg(
        F.max(F.when(F.col("h.is_lo"), F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("h.is_hi"), F.col("_v"))).alias("_hi"),
        F.max(F.col("h.p")).alias("_p"))
    frac = F.col("_p") - F.floor(F.col("_p"))
    return agg.select(*[F.col(f"`{b}`") for b in by], "q",
                      (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("value"))


def _hits(pos: DataFrame, qs: Sequence[float], by: list[str]) -> DataFrame:
    """The rows that hold one of the two ranks of a quantile, as ``h``."""
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    p = lambda q: q * (F.col("_total") - 1)
    start, end = F.col("_before"), F.col("_before") + F.col("_n")

    def holds(i):
        return (start <= i) & (i < end)

    return pos.select(
        *[F.col(f"`{b}`") for b in by], "_v", *[c for c in pos.columns if c == "_gap"],
        F.explode(F.filter(
            F.transform(qarr, lambda q: F.struct(
                q.alias("q"), p(q).alias("p"),
                holds(F.floor(p(q))).alias("is_lo"), holds(F.ceil(p(q))).alias("is_hi"))),
            lambda s: s["is_lo"] | s["is_hi"])).alias("h"))


ACCURACY, MOST_ACCURACY = 10_000, 1_000_000


def bracketed_quantiles(df: DataFrame, column: str, qs: Sequence[float], by: Sequence[str] = (),
                        null_groups: bool = False, accuracy: int = ACCURACY,
                        n_buckets: int | None = None) -> DataFrame:
    """Exact quantiles in two scans, as ``exact_quantiles`` returns them.

    The first scan sketches each group (``percentile_approx``): a bracket of values
    around each wanted rank, three times as wide as the sketch's error; groups of up to
    ``accuracy`` rows take the whole line, and the brackets of the others are sent to all
    tasks. In the second, values inside a bracket are
    counted one by one and all others by the gap between brackets they fall into, both
    in map-side partial aggregates, so neither all values nor a frequent value is
    shuffled. Running counts over what is kept give the ranks. If a rank should lie in a
    gap after all, or more is kept of a group than one task may order, the position
    table answers instead; nothing rests on the sketch but speed."""
    by, keys = list(by), [F.col(f"`{b}`") for b in by]
    rows = df.select(*keys, F.col(f"`{column}`").cast("double").alias("_v")).where("_v is not null")
    for b in [] if null_groups else by:
        rows = rows.where(F.col(f"`{b}`").isNotNull())
    margin, ends = 3.0 / accuracy, []
    for q in qs:
        ends += [max(0.0, q - margin), min(1.0, q + margin)]
    # the sketch orders numbers; NaN, which Spark sorts last, goes with the infinite ones
    number = F.when(F.isnan("_v"), float("inf")).otherwise(F.col("_v"))
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"),
                                   F.percentile_approx(number, ends, accuracy).alias("_ends"))
    whole, nan, least = F.col("_rows") <= accuracy, F.lit(float("nan")), F.lit(float("-inf"))
    brackets = [f"_{side}{i}" for i in range(len(qs)) for side in "lh"]
    told = told.select(*keys, whole.alias("_whole"), *[x.alias(n) for x, n in zip([x for i, q in enumerate(qs) for x in (
        F.when(whole | F.lit(q <= margin), least).otherwise(F.get("_ends", F.lit(2 * i))),
        F.when(whole | F.lit(q >= 1 - margin) | (F.get("_ends", F.lit(2 * i + 1)) == float("inf")), nan)
        .otherwise(F.get("_ends", F.lit(2 * i + 1))))], brackets)])
    if by:
        # a join by sorting would gather each group in one task; the groups with brackets of
        # their own, at most one for ``accuracy`` rows, go to the rows instead
        large = F.broadcast(told.where(~F.col("_whole")).drop("_whole"))
        marked = null_safe_join(rows, large, by, "left").select(*keys, "_v", *[
            F.coalesce(n, least if n.startswith("_l") else nan).alias(n) for n in brackets])
    else:
        marked = _scalar_join(rows, told)
    inside, gap = F.lit(False), F.lit(0)
    for i in range(len(qs)):
        inside = inside | F.col("_v").between(F.col(f"_l{i}"), F.col(f"_h{i}"))
    for i in range(len(qs)):
        gap = gap + (F.col("_v") > F.col(f"_h{i}")).cast("int")
    entries = marked.groupBy(*keys, F.when(~inside, gap).alias("_gap"), F.when(inside, F.col("_v")).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v")).drop("_x")
    entries = materialize(entries, "brackets")
    if largest_group(entries, by, []) > single_task_rows(df):
        return exact_quantiles(df, column, qs, by, n_buckets, null_groups, "positions")
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.select("*", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"),
                            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    if not _hits(placed, qs, by).where("_gap is not null").isEmpty():
        return exact_quantiles(df, column, qs, by, n_buckets, null_groups, "positions")
    return _interpolated(placed, qs, by)


def quantile_array(df: DataFrame, column: str, qs: Sequence[float], by: Sequence[str] = (),
                   exact: bool = True, accuracy: int = 10000, null_groups: bool = False) -> DataFrame:
    """``(by..., values)`` where ``values`` is an array aligned with ``qs``.

    ``exact=False`` uses ``percentile_approx`` (one pass, bounded memory).
    """
    by = list(by)
    if not exact:
        return df.groupBy(*by).agg(F.percentile_approx(
            F.col(f"`{column}`").cast("double"), [float(q) for q in qs], accuracy).alias("values"))
    long = exact_quantiles(df, column, qs, by, null_groups=null_groups)
    return long.groupBy(*by).agg(F.array(*[
        F.max(F.when(F.abs(F.col("q") - F.lit(float(q))) < 1e-12, F.col("value"))) for q in qs
    ]).alias("values"))


def segmented_last(df: DataFrame, values, order, by: Sequence[str] = (),
                   n_buckets: int | None = None, strategy: str = "auto") -> DataFrame:
    """Forward fill: each row gets, per column in ``values``, the last
    non-null value at or before it in ``order`` (ascending keys, nulls last)
    within its group (C6), without sending a whole group to one task.

    Above ``gridspark.singleTaskRows`` the rows are written once in slices of
    the order (``range_buckets``). A window fills inside each slice and group,
    and the last non-null value of the group's earlier slices (a table of one
    row per slice and group) fills the rest. Rows tied on the whole order key
    are filled in an unspecified order among themselves.
    """
    values = [values] if isinstance(values, str) else list(values)
    order = _norm_order(order)
    if not all(asc for _, asc in order):
        raise ValueError("forward fill needs ascending order keys")
    by = list(by)
    groups = [F.col(f"`{b}`") for b in by]
    if choose_strategy(df, strategy, by, []) == "window":
        w = Window.partitionBy(*groups).orderBy(*sort_order(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[F.last(F.col(f"`{c}`"), ignorenulls=True).over(w).alias(c) if c in values
                           else F.col(f"`{c}`") for c in df.columns])
    rows = range_buckets(df, order, by, n_buckets)
    w = Window.partitionBy("_b", *groups).orderBy(*sort_order(order), "_uid").rowsBetween(
        Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.last(F.col(f"`{v}`"), ignorenulls=True).over(w).alias(f"_fill{i}")
                               for i, v in enumerate(values)])
    place = F.struct(order_key([k for k, _ in order]).alias("k"), F.col("_uid"))
    tails = rows.groupBy("_b", *groups).agg(*[
        F.max_by(F.col(f"`{v}`"), F.when(F.col(f"`{v}`").isNotNull(), place)).alias(f"_t{i}")
        for i, v in enumerate(values)])
    wg = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_b", *groups, *[F.last(f"_t{i}", ignorenulls=True).over(wg).alias(f"_c{i}")
                                          for i in range(len(values))])
    res = null_safe_join(local, carry, ["_b", *by], how="left")
    return res.select(*[
        (F.coalesce(F.col(f"_fill{values.index(c)}"), F.col(f"_c{values.index(c)}")).alias(c)
         if c in values else F.col(f"`{c}`")) for c in df.columns])
