"""Saved view specifications (V1): filters -> sort -> columns -> page,
kept as JSON and applied as one lazy plan."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from gridspark.operators.filter import canonical_operator, filter_stack
from gridspark.operators.order import sort_columns
from gridspark.operators.project import page as page_rows

VIEW_KEYS = ("name", "filters", "sort", "columns", "page", "page_size")


def validate_view(spec: dict, columns) -> list[str]:
    """Problems with a view spec against the current columns (empty list:
    valid). Unknown filter or sort columns are reported, not fatal."""
    problems = []
    for k in spec:
        if k not in VIEW_KEYS:
            problems.append(f"unknown key {k!r}")
    for f in spec.get("filters", []):
        if f.get("column") not in columns:
            problems.append(f"filter column {f.get('column')!r} not in table")
        try:
            canonical_operator(f.get("op", ""))
        except ValueError as e:
            problems.append(str(e))
    for s in _sort_items(spec):
        if s[0] not in columns:
            problems.append(f"sort column {s[0]!r} not in table")
    for c in spec.get("columns", []) or []:
        if c not in columns:
            problems.append(f"column {c!r} not in table")
    size = spec.get("page_size")
    if size is not None and (not isinstance(size, int) or size < 1):
        problems.append("page_size must be a positive integer")
    return problems


def _sort_items(spec: dict) -> list[tuple[str, bool]]:
    s = spec.get("sort") or []
    if isinstance(s, dict):
        asc = bool(s.get("ascending", True))
        return [(c, asc) for c in s.get("columns", [])]
    out = []
    for item in s:
        if isinstance(item, dict):
            out.append((item["column"], bool(item.get("ascending", True))))
        elif isinstance(item, (list, tuple)):
            out.append((item[0], bool(item[1])))
        else:
            out.append((item, True))
    return out


def apply_view(df: DataFrame, spec: dict) -> DataFrame:
    """Apply a view: filters (AND; filters on missing columns skipped),
    sort (missing sort columns dropped), column selection (missing columns
    dropped), then the page when ``page`` is set."""
    out = filter_stack(df, spec.get("filters", []))
    order = [(c, a) for c, a in _sort_items(spec) if c in df.columns]
    if order and not spec.get("page"):
        out = out.orderBy(*sort_columns(out, order))
    cols = [c for c in (spec.get("columns") or []) if c in df.columns]
    if spec.get("page"):
        size = int(spec.get("page_size") or 100)
        key = order or [(c, True) for c in (cols or df.columns)]
        out = page_rows(out, int(spec["page"]), size, key)
    if cols:
        out = out.select(*[f"`{c}`" for c in cols])
    return out


def view_to_json(spec: dict) -> str:
    return json.dumps({k: spec[k] for k in VIEW_KEYS if k in spec}, sort_keys=True)


def view_from_json(text: str) -> dict[str, Any]:
    spec = json.loads(text)
    if not isinstance(spec, dict):
        raise ValueError("a view is a JSON object")
    return spec
