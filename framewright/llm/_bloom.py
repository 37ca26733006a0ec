"""Bloom filters built and tested in DataFrame functions, as rows of packed bits.

A filter has a power of two of cells, never more than the caller's bound, so what is sent to executors has a
proven size.  Keys are longs that are already well mixed; two of their bit ranges name two cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import durable

#: Bits that one row holds, as bitmap_construct_agg packs them.
ROW_BITS = 32768
#: Bits by which the second cell's range is shifted: keys of 48 bits still give two cells.
SHIFT = 18


def filter_bits(n: int, per_key: int, most: int) -> int:
    bits = ROW_BITS
    while bits < min(most, n * per_key):
        bits *= 2
    return bits


def cells(key: Column, bits: int) -> list[Column]:
    return [key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, SHIFT).bitwiseAND(F.lit(bits - 1))]


@dataclass
class Bloom:
    rows: DataFrame  # at, bits: at most `bits` / 8 bytes in all
    bits: int

    def maybe(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """Add the boolean column `out`: whether the key is possibly in the filter."""
        found = []
        for i, cell in enumerate(cells(key, self.bits)):
            part = F.broadcast(self.rows.select(F.col("at").alias(f"__at{i}"), F.col("bits").alias(f"__bits{i}")))
            df = df.withColumn(f"__at{i}", F.shiftright(cell, 15)).join(part, f"__at{i}", "left")
            pos = cell.bitwiseAND(F.lit(ROW_BITS - 1))
            byte = F.conv(F.hex(F.substring(F.col(f"__bits{i}"), F.shiftright(pos, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found.append(F.coalesce(F.call_function("shiftright", byte, pos.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(1) == 1, F.lit(False)))
        both = df.withColumn(out, reduce(lambda a, b: a & b, found))
        return both.drop(*[f"__{what}{i}" for i in range(2) for what in ("at", "bits")])

    def array(self) -> np.ndarray:
        """The whole filter as bytes, for Python workers."""
        out = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in self.rows.toLocalIterator():
            part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
            at = r["at"] * (ROW_BITS // 8)
            out[at : at + len(part)] = part[: len(out) - at]
        return out


def test(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Bloom.maybe for an array of keys (uint64)."""
    mask, good = np.uint64(len(filter_) * 8 - 1), True
    for shift in (0, SHIFT):
        cell = (keys >> np.uint64(shift)) & mask
        good = good & ((filter_[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return good


def from_cells(cell_rows: DataFrame, bits: int, tag: str) -> Bloom:
    """cell_rows: one column `cell`."""
    rows = cell_rows.groupBy(F.shiftright("cell", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(ROW_BITS - 1))).alias("bits"))
    return Bloom(durable(rows, tag), bits)


def from_keys(keys: DataFrame, key: Column, n: int, tag: str, per_key: int = 16, most: int = 1 << 28) -> Bloom:
    bits = filter_bits(n, per_key, most)
    return from_cells(keys.select(F.explode(F.array(*cells(key, bits))).alias("cell")), bits, tag)
