import hashlib
import re

from pyspark.sql import functions as F

from framewright.llm.exact import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [k for (k, _), m in zip(rows, norm, strict=True) if m == n]
        ids = [k for k in same if k is not None]
        out.append((i, min(ids) if ids else None, len(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (5, None), (4, ""), (7, "x" * 100_000), (6, "x" * 100_000), (None, "a b"), (9, "once"), (9, "once"), (8, "Ünïcode x"), (None, "null id")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("__sha", F.lit(1))
    got = exact_dedup(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ROWS)


def test_one_row_of_each_group_stays(spark):
    got = exact_dedup(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_saturated_filter_stays_exact(spark):
    rows = [(i, f"text {i // 2 if i % 5 == 0 else i}") for i in range(5000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most_bits=1024).collect()
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {r.doc_id: r.keep_id for r in got} == {i: first[t] for i, t in rows}


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
