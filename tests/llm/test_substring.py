import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from framewright.llm.substring import substring_dedup


def brute(rows, k):
    w = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), x in zip(rows, w, strict=True):
        for p in range(len(x) - k + 1):
            g = tuple(x[p : p + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), x in zip(rows, w, strict=True):
        gone = set()
        for p in range(len(x) - k + 1):
            f = first.get(tuple(x[p : p + k]))
            if f is not None and (i is None or f < i):
                gone |= set(range(p, p + k))
        kept = " ".join(v for j, v in enumerate(x) if j not in gone)
        out.append((i, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(rng.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randint(0, 30))] for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        text = rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)
        rows.append((rng.choice([i, i, i, max(0, i - 3)]), text))
    return [*rows, (100, None), (101, ""), (102, "few words"), (103, rows[4][1]), (104, rows[4][1]), (104, rows[4][1]), (None, rows[5][1]), (None, rows[5][1] + " tail"), (105, "rep " * 60), (106, "rep " * 60 + "x"), (107, " ".join(str(j) for j in range(20_000)))]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k", [13, 6])
def test_matches_brute_force(spark, seed, k):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("sha", F.lit(1))
    got = substring_dedup(df, k=k).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, k)


def test_spans_point_at_equal_source_text(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, "x y " + " ".join(f"a{i}" for i in range(5, 30)) + " z")]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = got[2].spans[0]
    assert (s.start, s.stop, s.source, s.source_start) == (2, 27, 1, 5) and got[1].spans == []


def test_saturated_filter_and_empty_table(spark):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, most_bits=32768).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 13)
    assert substring_dedup(df.where("false")).collect() == []


def test_one_row_each_when_filters_let_everything_through(spark, monkeypatch):
    from framewright.llm import _bloom

    monkeypatch.setattr(_bloom.Bloom, "maybe", lambda self, df, key, out: df.withColumn(out, F.lit(True)))
    text = " ".join(f"w{i}" for i in range(40))
    rows = [*((i, text) for i in range(6)), (None, text), (3, text), (7, text + " tail"), (8, "something else " * 9), (9, None)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=13).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 13)


@pytest.mark.parametrize("bits", [5, 12])
def test_claims_under_colliding_nodes_are_settled_by_the_words(spark, bits):
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, bits=bits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 13)


def test_nonbranching_paths_are_compacted(spark):
    from framewright.llm import substring as s

    # edges of one source 0-1-2-3-4-5 and, of another, an edge that enters node 3
    rows = [(0, 1, 7, 0, 10), (1, 2, 7, 0, 11), (2, 3, 7, 0, 12), (3, 4, 7, 0, 13), (4, 5, 7, 0, 14), (9, 3, 8, 0, 4)]
    got = {(r.src, r.spos): r.path for r in s.compacted(spark.createDataFrame(rows, "u long, v long, src long, skey long, spos int")).collect()}
    assert got == {(7, 10): 10, (7, 11): 10, (7, 12): 10, (7, 13): 13, (7, 14): 13, (8, 4): 4}


def test_many_repeats_of_one_row_and_many_texts_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), *[(2, text + " x")] * 50, *[(2, f"head{i} " + text) for i in range(20)], *[(None, f"h{i} " + text) for i in range(20)]]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 13)
