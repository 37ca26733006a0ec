import random

import pytest
from pyspark.sql import functions as F

from framewright.llm.mix import fit_lengths, mix, subset_sum, targets


def test_targets_refill():
    t = targets([("a", 10), ("b", 1000), (None, 5)], lambda i, _: i % 3 + 1, 3)
    assert t["a"] == 30 and t[None] == 15 and abs(t["b"] - 970) < 1e-9
    assert abs(sum(t.values()) - 1015) < 1e-9


@pytest.mark.parametrize("seed", range(20))
def test_subset_sum_is_optimal(seed):
    rng = random.Random(seed)
    items = [(rng.randint(1, 30), rng.randint(1, 4)) for _ in range(6)]
    budget, sums = rng.randint(0, 200), {0}
    for size, n in items:
        sums = {s + size * k for s in sums for k in range(n + 1)}
    got = subset_sum(budget, [(s, n) for s, n in {s: n for s, n in items}.items()])
    per = {s: n for s, n in items}
    sums = {0}
    for size, n in per.items():
        sums = {s + size * k for s in sums for k in range(n + 1)}
    assert sum(s * k for s, k in got.items()) == max(x for x in sums if x <= budget)
    assert all(k <= per[s] for s, k in got.items())


def test_fit_keeps_bounds_and_comes_near():
    rng = random.Random(1)
    lengths = [(s, rng.randint(1, 50)) for s in range(1, 900, 7)]
    total = sum(s * n for s, n in lengths)
    for part in (0.01, 0.3, 0.77, 0.999):
        got = fit_lengths(lengths, int(total * part), 4)
        assert all(got[s] <= n for s, n in lengths)
        assert 0 <= int(total * part) - sum(s * k for s, k in got.items()) < 10


ROWS = [(i, " ".join(["w"] * (i % 37 + 1)), "abc"[min(i // 100, 2)]) for i in range(400)] + [(1000, None, "a"), (1001, "", None), (1002, "x y", None), (None, "n n", "b"), (5, "five again", "a"), (5, "five again", "a")]


def test_taken_words_meet_targets(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix(df).collect()
    assert len(got) == len(ROWS) and {r.copies for r in got} <= {0, 1, 2, 3}
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 3
    assert got and sorted(map(repr, got)) == sorted(map(repr, mix(df).collect()))


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
