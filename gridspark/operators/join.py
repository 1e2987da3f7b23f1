"""Joins, lookups and concatenation.

Join strategy is left to Spark: with AQE on, a side whose *measured*
runtime size is below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast,
anything else is a sort-merge join, and skewed partitions of the big side
are split (``spark.sql.adaptive.skewJoin``). No join carries a broadcast hint.

A cross join operator is deliberately not offered (it emits all pairs).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column, resolve_columns
from gridspark.operators.aggregate import agg_expr, canonical_agg
from gridspark.functions.names import plain_names
from gridspark.plans.ordered import order_key, row_numbers

JOIN_TYPES = {"left": "left", "inner": "inner", "outer": "full_outer", "full": "full_outer",
              "full_outer": "full_outer", "right": "right", "left_semi": "left_semi",
              "semi": "left_semi", "left_anti": "left_anti", "anti": "left_anti"}


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def _how(how: str) -> str:
    h = how.lower()
    if h == "cross":
        raise ValueError("cross joins are not offered: they emit every pair of rows")
    if h not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; choose from {sorted(JOIN_TYPES)}")
    return JOIN_TYPES[h]


def join(left: DataFrame, right: DataFrame, left_on, right_on=None, how: str = "left",
         suffixes: tuple[str, str] = ("_L", "_R"), null_safe: bool = False,
         select: Sequence[str] | None = None) -> DataFrame:
    """Join on ``left_on = right_on`` (lists allowed).

    Non-key columns present on both sides get ``suffixes``. Key columns with
    the same name are kept once (coalesced for full/right joins); keys with
    different names are both kept. ``null_safe`` matches null to null.
    ``select`` picks output columns afterwards.
    """
    h = _how(how)
    lk = resolve_columns([left_on] if isinstance(left_on, (str, int)) else left_on, left.columns)
    rk_refs = right_on if right_on is not None else left_on
    rk = resolve_columns([rk_refs] if isinstance(rk_refs, (str, int)) else rk_refs, right.columns)
    if len(lk) != len(rk):
        raise ValueError("left and right key lists differ in length")
    same = {a for a, b in zip(lk, rk) if a == b}
    clash = (set(left.columns) & set(right.columns)) - same
    lsel = [(_c(c).alias(c + suffixes[0]) if c in clash else _c(c)) for c in left.columns]
    rsel = []
    for c in right.columns:
        if c in same:
            rsel.append(_c(c).alias(f"__rk_{c}"))
        elif c in clash:
            rsel.append(_c(c).alias(c + suffixes[1]))
        else:
            rsel.append(_c(c))
    L, R = left.select(*lsel), right.select(*rsel)
    lname = {c: (c + suffixes[0] if c in clash else c) for c in left.columns}
    rname = {c: (f"__rk_{c}" if c in same else (c + suffixes[1] if c in clash else c))
             for c in right.columns}
    conds = []
    for a, b in zip(lk, rk):
        la, rb = L[f"`{lname[a]}`"], R[f"`{rname[b]}`"]
        conds.append(la.eqNullSafe(rb) if null_safe else la == rb)
    out = L.join(R, on=conds, how=h)
    if h in ("left_semi", "left_anti"):
        return out
    cols = []
    for c in left.columns:
        if c in same:
            k = _c(lname[c])
            if h in ("full_outer", "right"):
                k = F.coalesce(k, _c(f"__rk_{c}"))
            cols.append(k.alias(c))
        else:
            cols.append(_c(lname[c]))
    cols += [_c(rname[c]) for c in right.columns if c not in same]
    out = out.select(*cols)
    if select:
        out = out.select(*[_c(resolve_column(s, out.columns)) for s in select])
    return out


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every column name the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared columns to join on")
    return join(left, right, shared, shared, how=how)


def vlookup_join(left: DataFrame, right: DataFrame, left_key, right_key, how: str = "left") -> DataFrame:
    """The right key is renamed to the left key, giving one key column."""
    lk = resolve_column(left_key, left.columns)
    rk = resolve_column(right_key, right.columns)
    if rk != lk:
        if lk in right.columns:
            raise ValueError(f"right table already has a column {lk!r}")
        right = right.withColumnRenamed(rk, lk)
    return join(left, right, lk, lk, how=how)


LOOKUP_AGGS = ("first", "last", "mean", "sum", "min", "max", "count")


def lookup_column(left: DataFrame, right: DataFrame, left_key, right_key, value,
                  agg: str = "first", order_by: Sequence[str] | None = None,
                  name: str | None = None) -> DataFrame:
    """Add one column looked up from ``right``; never multiplies rows.

    ``first`` / ``last`` take the value of the first / last matching right
    row in ``order_by`` order (required; nulls last, ties arbitrary). The other aggregates reduce the
    right table per key with a partial aggregate before the join.
    """
    lk = resolve_column(left_key, left.columns)
    rk = resolve_column(right_key, right.columns)
    v = resolve_column(value, right.columns)
    out = name or (v if v not in left.columns else f"{v}_lookup")
    a = agg.lower()
    if a not in LOOKUP_AGGS:
        raise ValueError(f"unknown lookup aggregate {agg!r}; choose from {LOOKUP_AGGS}")
    if a in ("first", "last"):
        if not order_by:
            raise ValueError("first/last lookups need order_by")
        ob = resolve_columns(order_by, right.columns)
        key = order_key(ob)
        pick = F.min_by if a == "first" else F.max_by
        red = right.where(_c(rk).isNotNull()).groupBy(_c(rk).alias("__k")).agg(
            pick(_c(v), key).alias(out))
    else:
        red = right.where(_c(rk).isNotNull()).groupBy(_c(rk).alias("__k")).agg(
            agg_expr(canonical_agg(a), v).alias(out))
    j = left.join(red, left[f"`{lk}`"] == red["__k"], "left")
    return j.select(*[left[f"`{c}`"] for c in left.columns], red[f"`{out}`"])


def stack(*dfs: DataFrame) -> DataFrame:
    """Vertical stack by column name (UNION ALL); missing columns null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def concat_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str],
                   right_order: Sequence[str], suffixes: tuple[str, str] = ("_L", "_R")) -> DataFrame:
    """Side-by-side by row position in the given orders (column names,
    or ``(name, ascending)`` pairs).

    Each side is numbered with the bucketed row numbering of
    ``plans.ordered`` (no single-task window; null keys last), then the two are full-outer
    joined on the number; the shorter side pads with nulls.
    """
    def numbered(df, order, stem):
        frame, to = plain_names(df, stem)
        keys = [to[o] if isinstance(o, str) else (to[o[0]], o[1]) for o in order]
        return row_numbers(frame, keys, name=f"_{stem}", null_keys=True), to

    ln, lto = numbered(left, left_order, "l")
    rn, rto = numbered(right, right_order, "r")
    clash = (set(left.columns) & set(right.columns))
    j = ln.join(rn, F.col("_l") == F.col("_r"), "full_outer")
    return j.select(*[F.col(n).alias(c + side if c in clash else c)
                      for to, side in ((lto, suffixes[0]), (rto, suffixes[1])) for c, n in to.items()],
                    F.coalesce("_l", "_r").alias("row_position"))
