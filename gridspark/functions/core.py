"""Column-level building blocks shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from Spark's own
functions, so it stays inside whole-stage codegen; nothing runs in Python
per row.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal what the spreadsheet tool accepts)
# ---------------------------------------------------------------------------
# Words read as true / false when converting text to a boolean.
TRUE_WORDS = ("true", "1", "yes", "y", "t", "on")
FALSE_WORDS = ("false", "0", "no", "n", "f", "off")
# Flag columns: text values accepted as a yes/no flag, and the "kept" sides.
FLAG_TEXT_VALUES = ("yes", "no", "y", "n", "true", "false")
FLAG_TRUTHY = ("y", "yes", "true")
FLAG_FALSY = ("n", "no", "false")
# Characters removed before reading text as a number: dollar, comma,
# percent and whitespace.
NUMBER_JUNK = r"[$,%\s]"
# Date formats tried, in order, when converting text to a date without an
# explicit format (Spark datetime patterns).
AUTO_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
)


# Cheap shape test run before the format list: every format above needs a
# numeric date (1-4 digits, separator, digits, separator, digits) or a month
# name next to a day and a 4-digit year.
DATE_SHAPE = (r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
              r"|[A-Za-z]{3,9}\.? \d{1,2}, \d{4}|\d{1,2} [A-Za-z]{3,9}\.? \d{4})")


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Blank / null tests
# ---------------------------------------------------------------------------

def is_blank(c) -> Column:
    """Null, or text made only of whitespace (spaces, tabs, newlines)."""
    c = as_col(c)
    return c.isNull() | c.cast("string").rlike(r"^\s*$")


def is_not_blank(c) -> Column:
    return ~is_blank(c)


def falsy(cond: Column) -> Column:
    """``NOT coalesce(cond, false)``: the row is kept when cond is null."""
    return ~F.coalesce(cond, F.lit(False))


def truthy(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


# ---------------------------------------------------------------------------
# Casts
# ---------------------------------------------------------------------------

def clean_number(c) -> Column:
    """Text such as ``$1,234.50`` or `` 12% `` read as a double; else null."""
    c = as_col(c)
    return F.regexp_replace(c.cast("string"), NUMBER_JUNK, "").try_cast("double")


def to_float(c) -> Column:
    """Any value read as a double; unparseable text becomes null."""
    return as_col(c).try_cast("double")


def to_int(c, on_fraction: str = "null") -> Column:
    """Symbol-cleaned number as a long.

    ``on_fraction`` decides what happens to a value with a fractional part:
    ``null`` (default) makes it null, ``round`` rounds half-even,
    ``truncate`` drops the fraction, ``error`` raises at run time.
    """
    num = clean_number(c)
    whole = num == F.floor(num)
    if on_fraction == "null":
        return F.when(whole, num.cast("long"))
    if on_fraction == "round":
        return F.bround(num, 0).cast("long")
    if on_fraction == "truncate":
        return num.cast("long")
    if on_fraction == "error":
        return F.when(num.isNull() | whole, num.cast("long")).otherwise(
            F.raise_error(F.lit("value has a fractional part")).cast("long"))
    raise ValueError(f"unknown on_fraction {on_fraction!r}")


def to_bool(c) -> Column:
    """Text to boolean by the fixed true / false word sets; else null."""
    t = F.lower(F.trim(as_col(c).cast("string")))
    return (F.when(t.isin(*TRUE_WORDS), F.lit(True))
             .when(t.isin(*FALSE_WORDS), F.lit(False)))


def to_date(c, fmt: str | None = None, formats: Iterable[str] = AUTO_DATE_FORMATS) -> Column:
    """Text to ``timestamp_ntz``; failures become null.

    With ``fmt`` only that Spark pattern is tried, else the fixed format list
    in order. Timestamps pass through unchanged.
    """
    c = as_col(c)
    s = F.trim(c.cast("string"))
    if fmt:
        return _wall_clock(s, fmt)
    return F.when(s.rlike(DATE_SHAPE), F.coalesce(*[_wall_clock(s, f) for f in formats]))


def _wall_clock(s: Column, fmt: str) -> Column:
    """``timestamp_ntz`` of a text in a Spark pattern, null if it does not fit.

    The zone-free parse keeps times that a zone skips (a gap in spring); it
    raises on other text, so the tolerant zoned parse decides what fits."""
    return F.when(F.try_to_timestamp(s, F.lit(fmt)).isNotNull(), F.to_timestamp_ntz(s, F.lit(fmt)))


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------

def strip(c) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` only
    removes spaces)."""
    return F.regexp_replace(as_col(c).cast("string"), r"^\s+|\s+$", "")


def title(c) -> Column:
    """Title case as Python's ``str.title``: a letter is upper-cased when the
    character before it is not a letter (``o'neil mc-donald`` ->
    ``O'Neil Mc-Donald``, ``3rd`` -> ``3Rd``), every other letter is
    lower-cased. Spark's ``initcap`` splits on spaces only; this is one
    array expression over the characters, still inside codegen."""
    s = as_col(c).cast("string")
    chars = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
        lambda i: F.when((i == 1) | ~F.substring(s, i - 1, 1).rlike(r"\p{L}"), F.upper(F.substring(s, i, 1)))
        .otherwise(F.lower(F.substring(s, i, 1))))
    return F.when(s.isNull(), F.lit(None).cast("string")).when(F.length(s) == 0, F.lit("")).otherwise(
        F.array_join(chars, ""))


def extract(c, pattern: str, group: int = 1) -> Column:
    """First regex group; no match gives null (not the empty string)."""
    s = as_col(c).cast("string")
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def literal_regex(text: str) -> str:
    """Java regex matching ``text`` literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal_replacement(text: str) -> str:
    """Replacement string with ``$`` and ``\\`` taken literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


# ---------------------------------------------------------------------------
# Dates
# ---------------------------------------------------------------------------

DATE_PARTS = ("year", "month", "day", "weekday", "quarter", "week", "hour", "dayofyear")


def date_part(c, part: str) -> Column:
    """Calendar part of a date; ``weekday`` is Monday = 0 … Sunday = 6."""
    c = as_col(c)
    fns = {
        "year": F.year, "month": F.month, "day": F.dayofmonth,
        "weekday": F.weekday, "quarter": F.quarter, "week": F.weekofyear,
        "hour": F.hour, "dayofyear": F.dayofyear,
    }
    if part not in fns:
        raise ValueError(f"unknown date part {part!r}; choose from {DATE_PARTS}")
    return fns[part](c)


def day_diff(a, b) -> Column:
    """Whole days from ``b`` to ``a``, floored towards minus infinity
    (-12 hours gives -1; Spark's ``datediff`` would give 0)."""
    # wall-clock difference (no time-zone conversion of timestamp_ntz values)
    micros = F.timestamp_diff("MICROSECOND", as_col(b), as_col(a))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


PERIODS = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def period_start(c, period: str) -> Column:
    """Start of the calendar period holding ``c`` (weeks start Monday)."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; choose from {tuple(PERIODS)}")
    return F.date_trunc(PERIODS[period], as_col(c)).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# Similarity
# ---------------------------------------------------------------------------

def similarity(a, b) -> Column:
    """0-100 score: ``100 * (1 - levenshtein / longer length)`` on lower-cased
    text; two empty strings score 100."""
    la, lb = F.lower(as_col(a).cast("string")), F.lower(as_col(b).cast("string"))
    longest = F.greatest(F.length(la), F.length(lb))
    return F.when(longest == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) * (F.lit(1.0) - F.levenshtein(la, lb) / longest))
