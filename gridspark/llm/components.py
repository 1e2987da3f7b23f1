"""Connected components of a table of links, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.llm.common import written


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest neighbour of ``u`` or ``u`` itself.

    The join has one more key than the aggregate is partitioned by, so both of
    its sides are shuffled for it and adaptive execution can split the rows of a
    node with very many neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(
        "u", F.xxhash64("u").alias("j"), F.least("u", "least").alias("m"))
    return edges.withColumn("j", F.xxhash64("u")).join(least, ["u", "j"]).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_min(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    star = _with_min(large)
    return (star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(star.select("u", F.col("m").alias("v"))).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its
    smallest node. Links with a null end are ignored, self-links make a node of
    its own component; an empty table gives an empty result.

    Each round (a large-star and a small-star step) writes the edge table to the
    shared folder; the number of rounds grows with the logarithm of the longest
    path, and only a row count and a checksum reach the driver."""
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    loops = ends.where("x = y").select(F.col("x").alias("node")).distinct()
    edges = written(ends.where("x <> y").select(
        F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = written(_round(edges), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
