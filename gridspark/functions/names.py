"""Column names that operators may use beside those of the user's table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str):
    """A column of any name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain_names(df: DataFrame, stem: str = "c") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to ``c0``, ``c1``, ... and the new name of
    each: names of an operator's own (which all begin with ``_``) never clash with
    them. A projection only, which Catalyst folds away."""
    to = {c: f"{stem}{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*to.values()), to


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that is not among ``taken`` (compared without case)."""
    low = {c.lower() for c in taken}
    name, n = stem, 0
    while name.lower() in low:
        n += 1
        name = f"{stem}_{n}"
    return name
