"""Shared Spark session and the small fixture frames of FIXTURES.md part 3."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridspark.session import checkpoint_dir, get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="gridspark-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, "x"), (2, None, None, None), (3, "b", 3.0, ""), (4, "a", None, "  "),
         (5, None, 5.0, "\t"), (6, "b", 6.0, "nan"), (7, "a", 7.0, "None")],
        "k long, g string, v double, t string")


@pytest.fixture(scope="session")
def ties(spark):
    return spark.createDataFrame(
        [(1, "x", 10), (2, "x", 20), (3, "x", 20), (4, "x", 30), (5, "y", 20), (6, "y", 20),
         (7, "y", None), (8, None, 5), (9, "y", 40)],
        "k long, g string, v long")


@pytest.fixture(scope="session")
def money(spark):
    return spark.createDataFrame(
        [(1, "$1,234.50"), (2, "12%"), (3, " 7 "), (4, "abc"), (5, "1.5"), (6, None), (7, "$1,000")],
        "k long, raw string")


@pytest.fixture(scope="session")
def flags(spark):
    return spark.createDataFrame(
        [(1, "Yes", 1, True), (2, "no", 0, False), (3, "Y", 1, True), (4, "n", 0, None),
         (5, "TRUE", None, False), (6, "false", 1, True), (7, None, 0, True)],
        "k long, yn string, b01 long, b boolean")


@pytest.fixture(scope="session")
def dates(spark):
    base = dt.datetime(2024, 3, 10, 12, 0, 0)
    rows = [(1, "2024-03-01", base, base + dt.timedelta(hours=12)),
            (2, "03/15/2024", base, base - dt.timedelta(hours=36)),
            (3, "junk", base, None),
            (4, "2024-03-01 08:30:00", None, base),
            (5, None, base, base)]
    return spark.createDataFrame(rows, "k long, raw string, a timestamp_ntz, b timestamp_ntz")


@pytest.fixture(scope="session")
def lookup(spark):
    return spark.createDataFrame(
        [("a", 1, 2), ("a", 2, 1), ("b", 3, 1), ("c", 4, 1), (None, 5, 1)],
        "key string, val long, ord long")


@pytest.fixture(scope="session")
def regex_frame(spark):
    return spark.createDataFrame(
        [(1, "a.b"), (2, "$1"), (3, "A.B"), (4, "\\d"), (5, "(x)"), (6, "axb")], "k long, t string")


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(0.0,), (2.0,), (5.0,), (10.0,), (11.0,)], "v double")


@pytest.fixture(scope="session")
def consts(spark):
    return spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "a double, c double")


def rows(df, *cols, order=None):
    """Collect (small test frames only) as a list of tuples."""
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t)) if order is None else out
