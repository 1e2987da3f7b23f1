"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.session import scratch_path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The six ASCII white-space characters that the text contracts name.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a lazy DataFrame."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Lets Python tasks import this package wherever the session runs: its source
    files go to the executors once, as ``--py-files`` would send them."""
    sc = spark.sparkContext
    if getattr(sc, "_gridspark_code", None) is not None:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="gridspark-code-")   # read by the driver only, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "gridspark-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(top, name)
                z.write(file, os.path.relpath(file, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._gridspark_code = path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Cuts the lineage: later stages re-read the files when an executor is lost,
    and the shuffle files of the job that made them are removed at its end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables that ``written`` made, after their last reader has ended."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text without any non-ASCII character takes the
    faster built-in, which does the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def by_size(batches: Iterator[pd.DataFrame], column: str, most: int) -> Iterator[pd.DataFrame]:
    """The rows of pandas batches in parts whose texts in ``column`` have at most
    ``most`` characters together, or of one row; bounds a task's memory."""
    for batch in batches:
        total = batch[column].str.len().fillna(0).cumsum().to_numpy()
        begin = 0
        while begin < len(batch):
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int((total <= before + most).sum()))
            yield batch.iloc[begin:end]
            begin = end
