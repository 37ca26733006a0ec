"""Connected components by alternating large-star and small-star steps, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import durable, release


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
    return r["n"], r["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b: long, without nulls); root is the component's smallest node.

    Each round links nodes to the smallest neighbour they know; the number of rounds grows with the logarithm
    of the longest chain.  Every round is written to the shared folder, so lineage stays short; minima are
    pre-aggregated on the map side and joins of hub nodes are left to adaptive skew handling.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = durable(small, "cc")
        now = _mark(new)
        release(e)
        e, before, mark = new, mark, now
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
