"""An order index: where the rows of a sort order lie, without sorting or writing them.

Bounds sampled from the order keys cut the order into slices; one aggregation over the
keys counts the rows of each. A page then reads the slices it needs, as a filter on the
keys (range predicates that reach the Parquet scan), and sorts only those. A slice that is
larger than one task may sort is cut again in the same way, by its keys and, where they
are all equal, by a hash of the row. The index holds bounds and counts only, at most
``SLICES`` for each slice cut, and serves any number of pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_column
from gridspark.functions.names import plain_names
from gridspark.plans.ordered import single_task_rows, sort_order

SLICES = 64
SAMPLED = 100 * SLICES     # keys read to the driver for one cut, about


@dataclass
class _Slice:
    where: list[str]                    # predicates of the slice, as SQL
    rows: int
    by: list[tuple[str, bool]]          # order keys with their direction
    parts: list["_Slice"] | None = field(default=None)


class OrderIndex:
    """Pages of ``df`` in the order of ``order_by`` (names or (name, ascending) pairs;
    nulls last). Rows equal in every order key come in the order of a row hash, so pages
    never share or miss a row. ``rows`` is the table's row count. The table must not
    change while the index is used. ``most``: rows that one task may sort (default:
    ``gridspark.singleTaskRows``)."""

    def __init__(self, df: DataFrame, order_by: Sequence, slices: int = SLICES, most: int | None = None):
        if not order_by:
            raise ValueError("an order index needs order_by")
        self._frame, by, self._hash = _prepared(df, order_by)
        self._columns, self._slices, self._most = df.columns, slices, most or single_task_rows(df)
        self._root = _Slice([], df.count(), by)

    @property
    def rows(self) -> int:
        return self._root.rows

    def _in(self, part: _Slice) -> DataFrame:
        df = self._frame.withColumn("_hash", self._hash) if any(k == "_hash" for k, _ in part.by) else self._frame
        for w in part.where:
            df = df.where(w)
        return df

    def _counted(self, part: _Slice, number: str) -> dict[int, int]:
        return {r["s"]: r["count"] for r in self._in(part).groupBy(F.expr(number).alias("s")).count().collect()}

    def _cut(self, part: _Slice) -> list[_Slice]:
        """``part`` in smaller slices, or with the row hash as one more key; none if its
        rows are equal in everything."""
        keys = self._in(part).select(*[F.col(k) for k, _ in part.by])
        share = min(1.0, SAMPLED / max(1, part.rows))
        found = _sorted_literals(keys.sample(share, seed=part.rows) if share < 1 else keys, part.by) or \
            _sorted_literals(keys.limit(1), part.by)
        step = max(1, len(found) // self._slices)
        bounds = [v for v, before in zip(found[step::step], [None, *found[step::step]]) if v != before]

        def slice_of(low: int, high: int) -> str:
            """The number of bounds that a row does not come before, by halving."""
            if low == high:
                return str(low)
            middle = (low + high) // 2
            return (f"CASE WHEN {_before(part.by, bounds[middle])} THEN {slice_of(low, middle)} "
                    f"ELSE {slice_of(middle + 1, high)} END")

        counts = self._counted(part, slice_of(0, len(bounds)))
        if max(counts.values()) < part.rows:
            return [_Slice([*part.where, *(_range(part.by, bounds[i - 1], True) if i else []),
                            *(_range(part.by, bounds[i], False) if i < len(bounds) else [])], counts[i], part.by)
                    for i in sorted(counts)]
        # one key holds (nearly) all: what comes before it, the key, what comes after it
        bound = found[len(found) // 2]
        before, equal = _before(part.by, bound), " AND ".join(f"{key} <=> {b}" for (key, _), b in zip(part.by, bound))
        counts = self._counted(part, f"CASE WHEN {before} THEN 0 WHEN {equal} THEN 1 ELSE 2 END")
        if counts.get(1) == part.rows:
            known = part.by[-1][0] == "_hash"
            return [] if known else [_Slice(part.where, part.rows, [*part.by, ("_hash", True)])]
        test = {0: before, 1: equal, 2: f"NOT ({before}) AND NOT ({equal})"}
        return [_Slice([*part.where, test[i]], counts[i], part.by) for i in sorted(counts)]

    def _read(self, part: _Slice, skip: int, take: int) -> list[DataFrame]:
        if part.rows > self._most and part.parts is None:
            part.parts = self._cut(part)
        if part.rows > self._most and part.parts:
            out, seen = [], 0
            for p in part.parts:
                first, last = max(skip - seen, 0), min(skip + take - seen, p.rows)
                if first < last:
                    out += self._read(p, first, last - first)
                seen += p.rows
            return out
        rows = self._in(part)
        if part.rows > self._most:                            # all equal: any rows will do
            return [rows.limit(take).withColumn("_hash", self._hash)]
        return [rows.withColumn("_hash", self._hash).orderBy(*sort_order(_all(part.by))).offset(skip).limit(take)]

    def page(self, number: int, size: int, reset_past_end: bool = True) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows; past the end page 1, or no rows
        unless ``reset_past_end``."""
        if number < 1 or size < 1:
            raise ValueError("page number and size must be >= 1")
        skip = (number - 1) * size
        if skip >= self.rows:
            if not reset_past_end or not self.rows:
                return self._frame.limit(0).toDF(*self._columns)
            skip = 0
        parts = self._read(self._root, skip, size)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if len(parts) > 1:
            out = out.orderBy(*sort_order(_all(self._root.by)))
        return out.drop("_hash").toDF(*self._columns)


def _prepared(df: DataFrame, order_by: Sequence) -> tuple[DataFrame, list[tuple[str, bool]], Column]:
    """The frame under plain names, its order keys, and a value for each row that orders
    rows equal in them (maps, which have no hash, by their text)."""
    frame, to = plain_names(df)
    by = []
    for o in order_by:
        name, ascending = (o, True) if isinstance(o, (str, int)) else (o[0], bool(o[1]))
        by.append((to[resolve_column(name, df.columns)], ascending))
    return frame, by, F.xxhash64(*[F.to_json(F.col(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name)
                                   for f in frame.schema])


def first_page(df: DataFrame, order_by: Sequence, size: int) -> DataFrame:
    """The first ``size`` rows as an ``OrderIndex`` orders them: a bounded top-k."""
    frame, by, row_hash = _prepared(df, order_by)
    return frame.withColumn("_hash", row_hash).orderBy(*sort_order(_all(by))).limit(size).drop("_hash").toDF(*df.columns)


def _all(by: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    return by if by[-1][0] == "_hash" else [*by, ("_hash", True)]


def _sorted_literals(keys: DataFrame, by: list[tuple[str, bool]]) -> list[tuple[str, ...]]:
    """The keys in their order, each value as an SQL literal: its text, cast back."""
    types = [f.dataType for f in keys.schema]
    shown = [F.hex(F.col(f.name)) if isinstance(f.dataType, T.BinaryType) else
             F.hex(F.encode(F.col(f.name).cast("string"), "UTF-8")) for f in keys.schema]
    rows = keys.orderBy(*sort_order(by)).select(*shown).collect()

    def literal(text: str | None, dtype: T.DataType) -> str:
        if text is None or isinstance(dtype, T.BinaryType):
            return f"CAST({'NULL' if text is None else f"unhex('{text}')"} AS {dtype.simpleString()})"
        return f"CAST(decode(unhex('{text}'), 'UTF-8') AS {dtype.simpleString()})"
    return [tuple(map(literal, r, types)) for r in rows]


def _is_null(literal: str) -> bool:
    return literal.startswith("CAST(NULL ")


def _before(by: list[tuple[str, bool]], bound: tuple[str, ...]) -> str:
    """Whether a row comes before ``bound`` in the order, nulls last."""
    out = "false"
    for (key, ascending), b in reversed(list(zip(by, bound))):
        earlier = f"{key} IS NOT NULL" if _is_null(b) else f"coalesce({key} {'<' if ascending else '>'} {b}, false)"
        out = f"({earlier} OR ({key} <=> {b} AND {out}))" if out != "false" else earlier
    return out


def _range(by: list[tuple[str, bool]], bound: tuple[str, ...], lower: bool) -> list[str]:
    """Predicates of the rows from ``bound`` on (``lower``) or before it; a plain
    comparison of the first key comes along, which the scan can use."""
    key, ascending = by[0]
    exact = f"NOT ({_before(by, bound)})" if lower else _before(by, bound)
    if _is_null(bound[0]):
        return [exact]
    wide = f"{key} {'>=' if ascending == lower else '<='} {bound[0]}"
    return [f"({wide} OR {key} IS NULL)" if lower else wide, exact]
