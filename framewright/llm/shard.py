"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of every source are shuffled by a seeded hash and ranked; row r of n gets the fraction (r + 1/2) / n.
Sorting all rows by fraction interleaves the sources in proportion, so cutting that order into equal runs
gives shards that each hold the mixture, and whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import durable, null_key, spread_rank


def assign_shards(docs: DataFrame, shards: int = 16, stratum: str | None = "source", id_col: str = "doc_id", carry: dict[str, Column] | None = None, seed: int = 17, target: int = 1024) -> DataFrame:
    """One row per row of docs: id, stratum, the carried expressions, `shard` (0 to shards-1) and `slot` (from 0, no gaps).

    Only id, stratum and carried values move; texts stay where they are.  Neither a source nor the whole order
    is sorted in one task: both are cut into hash or fraction buckets whose counts give the offsets.

    Null ids and null strata: kept, null is a stratum of its own.  Ties and repeated rows: each gets its own slot;
    rows that are alike in all carried columns may swap slots.  Empty table: no rows.  Fewer rows than shards:
    some shards stay empty.  Other columns of docs, whatever their names, are not read.
    """
    carry = carry or {}
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.col(stratum) if stratum else F.lit(None).cast("string")).alias("__stratum"),
        *[c.alias(f"__c_{k}") for k, c in carry.items()],
    ).withColumn("__key", null_key(F.col("__stratum")))
    rows = durable(rows, "shard-rows")
    tie = [F.col("__id"), *[F.col(f"__c_{k}") for k in carry]]
    per = durable(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")), "shard-strata")  # its size is known: no shuffle by stratum where it is small
    ranked = spread_rank(rows.join(per, "__key"), ["__key"], "__n", tie, seed, "__rank", target)
    # (2 r + 1) / 2 n: the middle of the row's share of its source, as a double
    ranked = ranked.withColumn("__f", (F.col("__rank") * 2 + 1) / (F.col("__n") * 2))
    ranked = durable(ranked.withColumn("__all", F.lit(0)), "shard-ranked")
    total = ranked.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    cells = max(1, -(-total // target))
    ranked = ranked.withColumn("__cell", F.floor(F.col("__f") * cells).cast("long"))
    # sizes has one row per cell, about total / target rows
    sizes = ranked.groupBy("__cell").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(F.lit(0)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    order = Window.partitionBy("__cell").orderBy("__f", "__key", "__rank")
    placed = ranked.join(sizes, "__cell").withColumn("__pos", F.row_number().over(order) - 1 + F.col("__before"))
    n = F.lit(max(total, 1)).cast("long")
    shard = F.expr(f"(__pos * {shards}L) div {max(total, 1)}L").cast("int")
    first = F.expr(f"(__shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    placed = placed.withColumn("__n", n).withColumn("__shard", shard).withColumn("__slot", F.col("__pos") - first)
    return placed.select(
        F.col("__id").alias(id_col),
        *([F.col("__stratum").alias(stratum)] if stratum and stratum not in carry else []),
        *[F.col(f"__c_{k}").alias(k) for k in carry],
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
    )
