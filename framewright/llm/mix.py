"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words.  What a source owes beyond whole passes over its documents is
fitted length by length: each length gives its proportional share, seeded single documents bring the rest down,
and a bounded knapsack closes what remains.  Which documents of a length are taken is decided by seeded hash.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import durable, null_key, spread_rank, word_count

#: Words that the knapsack may have to fit at most once the seeded documents are in.
DP_WORDS = 65536


def targets(sizes: list[tuple[str | None, int]], weights, most: int) -> dict[str | None, float]:
    """Target words per source: shares of all words by weight, none above `most` times its size; the excess is reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights(i, s)) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), [s for s, _ in order], {}
    while open_:
        share = sum(weight[s] for s in open_)
        rate = left / share if share else 0.0
        full = [s for s in open_ if rate * weight[s] > most * size[s]]
        if not full:
            out |= {s: rate * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
        gone = set(full)
        open_ = [s for s in open_ if s not in gone]
    return out


def subset_sum(budget: int, items: list[tuple[int, int]]) -> dict[int, int]:
    """Counts by length, each within its bound, whose sum is as near below the budget as any.

    Bounded knapsack: counts are split into powers of two and the reachable sums are the bits of an integer.
    """
    if budget <= 0:
        return {}
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for length, n in items:
        n, step = min(n, budget // length) if length > 0 else 0, 1
        while n > 0:
            k = min(step, n)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            n, step = n - k, step * 2
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, k, had in reversed(steps):
        if not had >> at & 1:
            at -= length * k
            out[length] = out.get(length, 0) + k
    return out


def fit_lengths(lengths: list[tuple[int, int]], budget: int, seed: int) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near below the budget as found."""
    lengths = sorted((size, n) for size, n in lengths if size > 0 and n > 0)
    total = sum(size * n for size, n in lengths)
    if budget >= total:
        return dict(lengths)
    took = {size: n * budget // total for size, n in lengths}
    left = budget - sum(size * k for size, k in took.items())
    free = {size: n - took[size] for size, n in lengths}
    order = [size for size, _ in lengths]
    random.Random(seed).shuffle(order)
    for size in order:
        if left <= DP_WORDS:
            break
        k = min(free[size], 1, left // size)
        took[size], free[size], left = took[size] + k, free[size] - k, left - k * size
    for size in sorted(order, reverse=True):  # only where single documents did not suffice
        if left > DP_WORDS and free[size]:
            k = min(free[size], left // size)
            took[size], free[size], left = took[size] + k, free[size] - k, left - k * size
    for size, k in subset_sum(left, [(size, free[size]) for size in order if free[size] and size <= left]).items():
        took[size] += k
    return took


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None, most: int = 3, seed: int = 17, size: Column | None = None, rows: str | None = None) -> DataFrame:
    """One row per row of docs: id, source, `size`, `source_size`, `target` and `copies` (times the mix takes it, 0 to most).

    weights(i, source): weight of source number i in order of code points, null last; without it 1, 2, 3, repeating.
    The driver gets one row per source.  A source's lengths are fitted in one task: there are at most
    sqrt(2 * words of the source) different lengths.  Sources and lengths that hold a third of all rows are
    ranked in buckets (see spread_rank), so no group meets in one task.

    Null text: size 0.  Null source: a source of its own, last.  Null ids and repeated rows: each row counts by
    itself; rows alike in id, source and size may swap copies.  Documents without words are taken as often as
    their source's whole passes say.  Empty table: no rows.  Other columns are not read.
    """
    weights = weights or (lambda i, _: i % 3 + 1)
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), (size if size is not None else word_count(F.col(text_col))).alias("__size"), *([F.col(rows).alias("__row")] if rows else []))
    d = durable(d.withColumn("__key", null_key(F.col("__source"))), "mix-sizes")
    hist = d.groupBy("__key", "__size").agg(F.count(F.lit(1)).alias("__n"))
    totals = hist.groupBy("__key").agg(F.sum(F.col("__size") * F.col("__n")).cast("long").alias("s")).collect()
    of = {r["__key"]: r["s"] for r in totals}
    goal = targets([(None if k == "0" else k[1:], s) for k, s in of.items()], weights, most)
    per = [(k, s, goal[None if k == "0" else k[1:]]) for k, s in sorted(of.items())]
    per_df = spark.createDataFrame(per, "__key string, __source_size long, __target double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, goal = int(pdf["__source_size"].iloc[0]), round(float(pdf["__target"].iloc[0]))
        whole = min(most, goal // s) if s else 0
        extra = fit_lengths([(int(a), int(b)) for a, b in zip(pdf["__size"], pdf["__n"], strict=True)], goal - whole * s if whole < most else 0, seed)
        return pdf.assign(__whole=whole, __extra=[extra.get(int(x), 0) for x in pdf["__size"]])[["__key", "__size", "__n", "__source_size", "__target", "__whole", "__extra"]]

    plan = hist.join(F.broadcast(per_df) if len(per) <= 10_000 else per_df, "__key")
    plan = plan.groupBy("__key").applyInPandas(fit, "__key string, __size long, __n long, __source_size long, __target double, __whole long, __extra long")
    plan = durable(plan, "mix-plan")
    tie = [F.col("__id"), *([F.col("__row")] if rows else [])]
    ranked = spread_rank(d.join(plan, ["__key", "__size"]), ["__key", "__size"], "__n", tie, seed, "__rank")
    return ranked.select(
        *([F.col("__row").alias(rows)] if rows else []),
        F.col("__id").alias(id_col),
        F.col("__source").alias(source_col),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__whole") + (F.col("__rank") < F.col("__extra")).cast("long")).alias("copies"),
    )
