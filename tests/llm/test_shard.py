from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm.shard import assign_shards

ROWS = [(i, f"s{0 if i < 300 else i % 7}") for i in range(1000)] + [(None, None), (None, None), (5, "s0"), (5, "s0")]


@pytest.mark.parametrize("target", [16, 4096])
def test_shards_are_even_and_match_the_mixture(spark, target):
    df = spark.createDataFrame(ROWS, "doc_id long, source string").withColumn("shard", F.lit("clash"))
    got = assign_shards(df, 16, target=target).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(ROWS)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    whole = Counter(r.source for r in got)
    for source, n in whole.items():
        per = [sum(r.source == source for r in got if r.shard == s) for s in range(16)]
        assert max(per) - min(per) <= 3, (source, n, per)  # one for the cut, the rest from other sources' rounding


def test_reruns_agree_and_few_rows(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)], "doc_id long, source string")
    one, two = (sorted(map(tuple, assign_shards(df, 16).collect())) for _ in range(2))
    assert one == two and all(r[3] == 0 for r in one)
    assert assign_shards(df.where("false"), 16).collect() == []
    with pytest.raises(ValueError):
        assign_shards(df, 0)
