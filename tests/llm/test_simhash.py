import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    ids, label = list(fps), {}
    for i in ids:
        label[i] = i
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= distance and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


TEXTS = ["", None, "  \t", "One two", "one TWO", "a b c d e f g", "A b c d\ne f g", "É é É", "é é é", "word " * 3000, "w x y z " * 7]


def test_fingerprints(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("fp", F.lit(1)).withColumn("component", F.lit("x"))
    got = {r.doc_id: r.fingerprint for r in simhash.near_dedup(df).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("paired", [32, 1])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_reach_the_same_components(spark, monkeypatch, paired, distance):
    import random

    rng, fps = random.Random(3), {}
    for i in range(40):  # chains of near fingerprints
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps[len(fps)] = x
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    signed = {i: simhash._signed(x) for i, x in fps.items()}
    df = spark.createDataFrame([(x,) for x in set(signed.values())], "fp long")
    from framewright.llm._components import components

    root = {r.node: r.root for r in components(simhash.links(df, distance)).collect()}
    got = {}
    for i, x in signed.items():
        got.setdefault(root.get(x, x), []).append(i)
    want = {}
    for i, c in brute_components(fps, distance).items():
        want.setdefault(c, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_every_close_pair_has_a_viable_chain_and_a_common_key(spark):
    import random

    rng, rows = random.Random(9), []
    masks = [simhash._signed(m) for m in simhash.key_masks(2)]
    for _ in range(300):
        a = b = rng.getrandbits(64)
        for _ in range(2):
            b ^= 1 << rng.randrange(64)
        a, b = simhash._signed(a), simhash._signed(b)
        assert any(a & m == b & m for m in masks)
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.where(simhash.viable(F.col("a"), F.col("b"), 2)).count() == 300


def test_null_ids_and_repeats(spark):
    rows = [(None, "same text here now"), (5, "same text here now"), (5, "same text here now"), (None, "other words stand alone")]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(5, 5), (5, 5)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["5", "None"]


def test_empty_table_and_bad_distance(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_dedup(empty).collect() == []
    with pytest.raises(ValueError):
        simhash.near_dedup(empty, distance=3)


def near_groups(rows, words=5, similarity=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and (a == b or len(a & b) >= similarity * len(a | b)):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return {frozenset(k for k, g in enumerate(group) if g == n) for n in set(group)}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(12):
        text = [word() for _ in range(rng.choice([4, 9, 30, 120, 400]))]
        for _ in range(rng.randint(1, 8)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 45))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))  # documents that share half of their words are no copies
    rows += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(30)]
    rows += [None, "", " \t", "one two", "One TWO", "one two three four five " * 40, "one two three four five " * 41]
    rows += [rows[0]] * 3
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(None if i % 17 == 3 else i // 2, i, t) for i, t in rows], "doc_id int, at int, text string").withColumn("key", F.lit("clash"))
    # ids repeat and are null, so rows are told by id and text
    got = simhash.near_copies(df).withColumnRenamed("doc_id", "id").collect()
    of = {}
    for r in got:
        of.setdefault(r.component, []).append((r.id, r.text_hash))
    told = {r["at"]: (r["doc_id"], r["h"]) for r in df.withColumn("h", F.xxhash64(F.lit(1), "text")).collect()}
    want = sorted((sorted(map(repr, (told[i] for i in g))) for g in near_groups(rows)), key=repr)
    assert sorted((sorted(map(repr, g)) for g in of.values()), key=repr) == want


def test_near_copies_of_a_chain_and_of_nothing(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join([*(f"x{j}" for j in range(i * 12)), *words[i * 12 :]]) for i in range(12)]  # neighbours are near, ends are not
    rows = list(enumerate(chain))
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len({r.component for r in got}) == len(near_groups(rows))
    assert simhash.near_copies(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_copies_that_are_not_near_enough_are_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(400):  # some link to each other, most differ from all others in a little too much
        copy = list(base)
        for p in rng.sample(range(150), rng.choice([1, 2, 4, 5, 6, 8, 10])):
            copy[p] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy[: rng.choice([150, 150, 140, 130])])))
    compared, durable = [], simhash.durable

    def seen(df, tag):
        out = durable(df, tag)
        if tag == "near-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "durable", seen)
    of = {}
    for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        of.setdefault(r.component, []).append(r.doc_id)
    assert set(map(frozenset, of.values())) == near_groups(rows) and len(of) > 200
    assert sum(compared) < 25 * len(rows), compared


@pytest.mark.parametrize("cells", [1, 64, 1 << 22])
def test_prefixes_lose_no_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(simhash, "CELLS", cells)
    rng, sets = random.Random(2), []
    for _ in range(40):
        base = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.choice([1, 2, 5, 9, 20, 60]))]
        for _ in range(5):
            sets.append(sorted({*rng.sample(base, max(1, len(base) - rng.randrange(4))), *(rng.randrange(1 << 60) for _ in range(rng.randrange(3)))}))
    df = spark.createDataFrame([(i, i // 2, s) for i, s in enumerate(sets)], "cls long, root long, s array<long>")
    near = {(i, j) for j, b in enumerate(map(set, sets)) for i, a in enumerate(map(set, sets[:j])) if i // 2 != j // 2 and len(a & b) >= 0.8 * len(a | b)}
    got = {(r.a, r.b) for r in simhash.across(simhash.prefixes(df, 0.8), 0.8).collect()}
    assert near <= got and len(near) > 50
