"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Every text becomes a digest once.  The first pass counts filter cells: a cell that two rows hit is set in the
filter.  The second pass tests every row: where all of its cells are set, its digest is possibly repeated, and
only such rows shuffle to meet their group.  All other rows are proven unique and pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bloom import cells, filter_bits, from_cells
from ._util import SPACE, durable

#: The filter is sent to every executor: 2**28 cells are 32 MiB.  Beyond, it lets more unique rows shuffle; results stay exact.
MOST_BITS = 1 << 28


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: id, keep_id (smallest id of the equal texts), group_size, kept, text_sha256.

    Exactly one row of a group is kept, that with the smallest id; of repeated rows with that id, the first
    as stored.  Null text counts as empty.  Null ids come after all others; keep_id is null only where no row of
    the group has an id.  Empty table: no rows.  Other columns are not read.
    The filter's size follows the number of rows up to most_bits; a hot group is counted on the map side and its
    small rows are dealt anew by adaptive skew handling.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("__hex"))
    rows = rows.select("__id", F.unhex("__hex").alias("__sha"), F.monotonically_increasing_id().alias("__row"))
    rows = durable(rows, "exact-digests")
    bits = filter_bits(rows.count(), bits_per_row, most_bits)
    key = F.xxhash64("__sha")

    # pass 1: cells that two rows hit
    hit = rows.select(F.explode(F.array_distinct(F.array(*cells(key, bits)))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = from_cells(hit.select("cell"), bits, "exact-filter")

    # pass 2: rows all of whose cells are set
    tested = durable(twice.maybe(rows, key, "__maybe"), "exact-tested")

    alone = tested.where(~F.col("__maybe")).select("__id", "__sha", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__n"), F.lit(True).alias("__kept"))
    some = tested.where("__maybe")
    first = F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    groups = some.groupBy("__sha").agg(first.alias("__first"), F.count(F.lit(1)).alias("__n"))
    groups = durable(groups, "exact-groups")  # so that adaptive skew handling sees both sides of the join
    met = some.join(groups, "__sha").select("__id", "__sha", F.col("__first.id").alias("__keep"), "__n", (F.col("__row") == F.col("__first.row")).alias("__kept"))
    return alone.unionByName(met).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"), F.col("__kept").alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256")
    )
