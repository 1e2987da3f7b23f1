"""Keyed edits written back to a partitioned table (C18 with S6)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.names import quoted
from gridspark.operators.clean import apply_edits
from gridspark.plans.ordered import materialize


def affected_partitions(table: DataFrame, edits: DataFrame, key: str, partition_by: Sequence[str]) -> list[tuple]:
    """Partition values of the rows that ``edits`` touch: a semi-join on the key and a
    distinct. One entry for each folder to rewrite, of which the driver lists all anyway."""
    keys = edits.select(quoted(key).alias("_key"))
    hit = table.join(keys, table[key] == keys["_key"], "left_semi").select(*map(quoted, partition_by)).distinct()
    return [tuple(r) for r in hit.collect()]


def edit_table(spark: SparkSession, path: str, edits: DataFrame, key: str, partition_by: Sequence[str],
               fmt: str = "parquet") -> int:
    """Apply ``edits`` (``key`` and the columns to overwrite; see ``apply_edits``) to the table
    at ``path`` and rewrite only the partitions that hold edited rows; returns their number.

    The edited rows are first written to the shared checkpoint folder, so the rewrite never
    reads what it replaces and can be repeated after a lost executor; then these partitions,
    and no others, are replaced (dynamic partition overwrite). Repeated edit keys raise
    before anything is written, and so do edits of partition columns, which would move rows."""
    moved = [c for c in edits.columns if c in partition_by]
    if moved:
        raise ValueError(f"partition columns cannot be edited: {moved}")
    table = spark.read.format(fmt).load(path)
    unknown = [c for c in [key, *edits.columns, *partition_by] if c not in table.columns]
    if unknown:
        raise ValueError(f"columns {unknown} are not in the table")
    twice = edits.where(quoted(key).isNotNull()).groupBy(quoted(key)).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"several edits of one {key}")
    folders = affected_partitions(table, edits, key, partition_by)
    if not folders:
        return 0
    if len(partition_by) == 1:
        values = [f[0] for f in folders if f[0] is not None]
        inside = quoted(partition_by[0]).isin(values) if values else F.lit(False)
        if len(values) < len(folders):
            inside = inside | quoted(partition_by[0]).isNull()
    else:
        inside = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [
            quoted(c).eqNullSafe(F.lit(v)) for c, v in zip(partition_by, f)]) for f in folders])
    changed = materialize(apply_edits(table.where(inside), edits, key), "edits")
    (changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
     .format(fmt).save(path))
    spark.catalog.refreshByPath(path)
    return len(folders)
