"""Column references: names, 1-based numbers, spreadsheet letters, ranges.

These work on the list of column names only (schema metadata on the
driver); no data is read.
"""

from __future__ import annotations

import difflib
import re
from typing import Sequence


def col_letter(index: int) -> str:
    """0-based column index to spreadsheet letters: 0 -> A, 26 -> AA."""
    if index < 0:
        raise ValueError("index must be >= 0")
    out = ""
    n = index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(ord("A") + r) + out
    return out


def parse_col_letter(letters: str) -> int:
    """Spreadsheet letters to a 0-based index: A -> 0, AA -> 26."""
    s = letters.strip().upper()
    if not s or not s.isalpha() or not s.isascii():
        raise ValueError(f"not column letters: {letters!r}")
    n = 0
    for ch in s:
        n = n * 26 + (ord(ch) - ord("A") + 1)
    return n - 1


def resolve_column(ref, columns: Sequence[str], fuzzy: float | None = None) -> str:
    """Resolve one reference against ``columns``.

    Order: exact name, case-insensitive name, 1-based number, letters,
    unique substring (case-insensitive), and with ``fuzzy`` (a similarity from
    0 to 1) the closest name at least that similar. Anything else raises
    ``KeyError`` naming the closest candidates.
    """
    cols = list(columns)
    if isinstance(ref, int):
        if 1 <= ref <= len(cols):
            return cols[ref - 1]
        raise KeyError(f"column number {ref} out of range 1..{len(cols)}")
    r = str(ref).strip()
    if r in cols:
        return r
    low = [c.lower() for c in cols]
    if low.count(r.lower()) == 1:
        return cols[low.index(r.lower())]
    if r.isdigit():
        i = int(r)
        if 1 <= i <= len(cols):
            return cols[i - 1]
        raise KeyError(f"column number {i} out of range 1..{len(cols)}")
    if r.isascii() and r.isalpha() and len(r) <= 3:
        i = parse_col_letter(r)
        if i < len(cols):
            return cols[i]
    hits = [c for c in cols if r.lower() in c.lower()]
    if len(hits) == 1:
        return hits[0]
    if len(hits) > 1:
        raise KeyError(f"column reference {ref!r} is ambiguous: {hits}")
    if fuzzy is not None:
        best = difflib.get_close_matches(r.lower(), low, n=1, cutoff=fuzzy)
        if best:
            return cols[low.index(best[0])]
    close = difflib.get_close_matches(r, cols, n=3, cutoff=0.5)
    raise KeyError(f"unknown column {ref!r}; did you mean {close or cols[:5]}?")


def resolve_columns(refs, columns: Sequence[str], fuzzy: float | None = None) -> list[str]:
    """Resolve several references, keeping order and dropping repeats."""
    out: list[str] = []
    for r in refs:
        c = resolve_column(r, columns, fuzzy)
        if c not in out:
            out.append(c)
    return out


_RANGE = re.compile(r"^\s*(\w+)\s*-\s*(\w+)\s*$")


def parse_column_list(spec: str, columns: Sequence[str]) -> list[str]:
    """Expand ``"1,3,5"``, ``"1-5"``, ``"A-C"``, ``"name, 4"`` or ``"all"``.

    Ranges are inclusive and may be numbers or letters; repeats are dropped
    and the first position wins.
    """
    cols = list(columns)
    if spec.strip().lower() in ("all", "*"):
        return cols
    out: list[str] = []
    for part in spec.split(","):
        if not part.strip():
            continue
        m = _RANGE.match(part)
        picked: list[str]
        if m and not any(part.strip() == c for c in cols):
            a, b = m.group(1), m.group(2)
            ia = cols.index(resolve_column(a, cols))
            ib = cols.index(resolve_column(b, cols))
            step = 1 if ib >= ia else -1
            picked = cols[ia: ib + step: step] if step == 1 else cols[ib: ia + 1][::-1]
        else:
            picked = [resolve_column(part, cols)]
        for c in picked:
            if c not in out:
                out.append(c)
    return out


def suggest_columns(ref: str, columns: Sequence[str], n: int = 3) -> list[str]:
    """Closest column names to ``ref`` (for error messages and pickers)."""
    return difflib.get_close_matches(ref, list(columns), n=n, cutoff=0.3)
