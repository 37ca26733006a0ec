import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import toxicity


@pytest.fixture(scope="module")
def trained(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_accuracy(spark, trained):
    docs, labels, t = trained
    s = toxicity.score(docs.select("doc_id", "text"), t).join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    r = s.agg(*[F.sum(((F.col("score") >= 0.3) == (F.lit(p) == 1)).cast("int") * (F.col("toxic") == y).cast("int")).alias(f"p{p}y{y}") for p in (0, 1) for y in (0, 1)]).first()
    assert r.p1y1 >= 0.85 * (r.p1y1 + r.p0y1)
    assert r.p1y0 <= 0.02 * (r.p1y0 + r.p0y0)


def test_obfuscated_words_are_restored(trained):
    r = toxicity.Restorer(trained[2][0])
    for spelt, word in (("m0r0n", "moron"), ("tr@sh", "trash"), ("stuuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("p4th3t1c", "pathetic"), ("cl0wn", "clown")):
        assert word in r.viterbi(spelt), (spelt, r.viterbi(spelt))
    words, runs = r.words("what an i d i o t, you sсum")
    assert "idiot" in runs or any("idiot" in x for x in runs)
    assert "scum" in words


def test_hard_texts_and_columns(spark, trained):
    rows = [(1, None), (2, ""), (None, "x" * 200_000), (3, "1" * 5000 + "a"), (3, "​ \U0001f600 @@@"), (4, "a b c d e f " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("other", F.lit("clash"))
    got = toxicity.score(df, trained[2]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.other == "clash" for r in got)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.score == 0.5 for r in got)
    assert toxicity.toxicity(docs.where("false"), none).collect() == []


def test_labels_of_held_out_rows_are_never_used(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1:] == b[1:]


def brute_viterbi(r, token):
    """The likeliest letter string by trying every path through the lattice."""
    two, best = toxicity.SYMBOLS * toxicity.SYMBOLS, []

    def go(i, a, b, cost, text):
        if i == len(token):
            best.append((cost + r.log[a * two + b * toxicity.SYMBOLS], text))
            return
        c = token[i]
        if c.isalpha():
            options = [(c, 0.0)] + ([("", toxicity.REPEAT)] if i and token[i - 1] == c else [])
        else:
            options = [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")] + ([(chr(97 + x), toxicity.WILD) for x in range(26)] if c in toxicity.ANY else [])
            options.append(("", toxicity.DROP_LEET if c in toxicity.LEET else toxicity.DROP))
        for letter, step in options:
            if letter:
                s = r._symbol(letter)
                go(i + 1, b, s, cost + step + r.log[a * two + b * toxicity.SYMBOLS + s], text + letter)
            else:
                go(i + 1, a, b, cost + step, text)

    go(0, 0, 0, 0.0, "")
    return max(best)[1]


def test_viterbi_finds_the_best_of_all_paths():
    import random

    import numpy as np

    rng = random.Random(2)
    counts = np.zeros(toxicity.SYMBOLS**3, dtype=np.int64)
    for text in ["the idiot said hello to all these people and the silly goose", "an idiot is a silly person", "hello there"] * 3:
        s = toxicity.symbols(text)
        np.add.at(counts, s[:-2] * (toxicity.SYMBOLS * toxicity.SYMBOLS) + s[1:-1] * toxicity.SYMBOLS + s[2:], 1)
    r = toxicity.Restorer(toxicity.log_model(counts))
    for token in ["1d10t", "h3ll0", "i.d.i.o.t", "s1lly", "iiddiioott", "id*ot", "$illy", "g00se", *("".join(rng.choice("idot1l0.*3s") for _ in range(7)) for _ in range(60))]:
        if token.count("*") < 3:
            assert r.viterbi(token)[0] == brute_viterbi(r, token), token
