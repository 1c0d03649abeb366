"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoca.sources.staging import stage


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: every node hands its (larger or smaller) neighbours to its least one."""
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # the large step looks at all neighbours, the small one at those below
    seen = edges.unionByName(swapped) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    moved = seen.join(least, seen["a"] == least["node"])
    if larger:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        moved = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node reachable.

    Each round shuffles the edges and writes them to the shared folder. The
    number of rounds grows with the logarithm of a component's size. Edges of a
    node to itself and null ends are passed over.
    """
    current = stage(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    marks = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == marks:
            break
        marks = tuple(now)
        current = stage(_stars(_stars(current, True), False), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
