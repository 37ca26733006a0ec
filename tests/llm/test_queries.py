import hashlib

from framewright.llm import queries


def test_op1_counts_rows_that_repeat_exactly(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, None, None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.unionByName(df.where("conv_id = 1 and turn = 0")).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op1_chat(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == 5 and got[1].loss_chars == 9 and got[2].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\n" * 2 + b"assistant\nyes\n" * 3).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"yesyesyes").hexdigest()


def test_op10_returns_every_accepted_paragraph(spark, tmp_path):
    text = "Intro\nReleased under the MIT License.\nand\nLicensed under the Apache License, Version 2.0."
    spark.createDataFrame([(1, text), (2, "no such line"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_license(spark, str(tmp_path)).collect()}
    assert [(x.paragraph, x.family, x.confirmed) for x in got[1].licences] == [(1, "MIT", True), (3, "Apache-2.0", True)]
    assert all(0 < x.probability <= 1 and 0 < x.similarity <= 1 for x in got[1].licences)
    assert got[2].licences == [] and got[3].licences == []
