import re

from framewright.llm.decontam import decontaminate


def toks(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, found = toks(t), set(), set()
        for k, x in items:
            b = toks(x)
            for s in range(max(1, len(b) - n + 1) if b else 0):
                g = b[s : s + n]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found.add(k)
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "short one"), (3, None), (4, ""), (5, "Repeat repeat repeat repeat"), (2, "short one"), (6, "é ü ß 日本 x1")]
DOCS = [
    (1, "The QUICK, brown fox jumps over. the end"), (2, "a short one and a short-one"), (3, None), (4, "!!"), (5, "repeat " * 9), (6, "É ü ß 日本 x1 é ü ß 日本 x1"),
    (7, "brown fox quick the"), (8, "fox jumps over the lazy dog " * 400), (8, "the quick brown fox jumps over the lazy dog"), (None, "short one"), (9, "short word one"),
]


def run(spark, **k):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = decontaminate(d, spark.createDataFrame(ITEMS, "item_id int, text string"), n=4, **k).collect()
    return got, sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got), key=repr)


def test_matches_brute_force(spark):
    got, rows = run(spark)
    assert rows == brute(DOCS, ITEMS, 4)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_hit == sum(s.stop - s.start for s in r.spans) for r in got)


def test_proximity_includes_exact_and_reaches_further(spark):
    got, _ = run(spark, slack=2)
    near = {r.doc_id: set(r.near_items) for r in got}
    assert 2 in near[9]
    assert all(set(r["items"]) <= set(r.near_items) for r in got)
    # the window would start before its document, where the rarest word stands first
    docs = spark.createDataFrame([(1, "nothing here"), (2, "zeta eta delta eps"), (3, "delta eps eta")], "doc_id long, text string").coalesce(1)
    item = spark.createDataFrame([(1, "delta eps zeta eta"), (2, "alpha eps zeta eta")], "item_id int, text string")
    assert {r.doc_id: r.near_items for r in decontaminate(docs, item, n=4, slack=4).collect()} == {1: [], 2: [1], 3: []}
    assert all(set(r["items"]) == set(r.near_items) for r in run(spark, slack=0)[0])


def test_blocks_of_the_benchmark_merge(spark):
    assert run(spark, block_words=3)[1] == run(spark)[1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate(d, none).collect())
    assert decontaminate(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id int, text string")).collect() == []


def test_an_index_serves_further_benchmarks(spark):
    from framewright.llm import decontam

    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = decontam.build_index(d)
    other = [("a", "jumps over the lazy"), ("b", "nothing of it"), (None, "É ü")]
    for items, kind in ((ITEMS, "int"), (other, "string")):
        got = decontam.search(index, spark.createDataFrame(items, f"item_id {kind}, text string"), n=4).collect()
        assert sorted(((r.id, r.n_words, r.n_hit, tuple(sorted(r["items"], key=repr))) for r in got), key=repr) == sorted(((i, n, h, tuple(sorted(x, key=repr))) for i, n, h, x in brute2(DOCS, items, 4)), key=repr)


def brute2(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, found = toks(t), set(), set()
        for k, x in items:
            b = toks(x)
            for s in range(max(1, len(b) - n + 1) if b else 0):
                g = b[s : s + n]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found.add(k)
        out.append((i, len(w), len(hit), found))
    return out


def test_windows_stay_small_and_are_put_from_the_rarest_term_on():
    import numpy as np

    from framewright.llm import decontam

    rng = np.random.default_rng(1)
    items = [(i, b" ".join(b"w%d" % x for x in rng.integers(0, 50_000, 2_000))) for i in range(50)]
    win = decontam.windows(items, 10)
    counts = rng.integers(1, 1000, len(win.terms))
    win.order(counts)
    grams, offsets, _ = win.by_length[0]
    rows = counts[np.take_along_axis(grams, offsets, axis=1)]
    assert (np.diff(rows, axis=1) >= 0).all() and len(win.starts) == len(grams) + 1
    held = win.terms.nbytes + grams.nbytes + offsets.nbytes + win.starts.nbytes + win.items.nbytes
    assert held < 110 * 100_000  # bytes a benchmark word: below 220 MB at 2 million words
