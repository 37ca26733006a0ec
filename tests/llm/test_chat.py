import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import chat

SCHEMA = "c int, msg int, seq int, kind string, role string, text string"


def run(spark, rows, **k):
    return {r.c: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)), ["c"], **k)).collect()}


def test_folding(spark):
    rows = [
        (1, 0, 0, "delta", "user", "Hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 2, "delta", "assistant", "draft"), (1, 1, 3, "regenerate", None, "Good"),
        (1, 1, 4, "delta", None, " day"), (1, 0, 5, "edit", None, "Hi<|end|>"), (1, 2, 6, "delta", "user", "gone"), (1, 2, 7, "delete", None, None), (2, 0, 1, None, None, None),
        (None, 0, 0, "delta", "assistant", "x"), (3, 0, 0, "delete", "user", ""),
    ]
    got = run(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "Hi<|end|>"), ("assistant", "Good day")]
    assert got[1].loss_texts == ["Good day"] and got[2].loss_texts == [] and got[None].loss_texts == ["x"] and 3 not in got
    s = got[1].spans[0]
    assert got[1].formatted[s.start : s.stop] == "Good day"


pieces = st.sampled_from(["</s>", "[INST]", "<|turn|>", "<|body|>", "<|end|>", "\\", "<", "[", "|end|>", "s>", "é", "日", " ", "a", "\n", "/INST]"])


def test_round_trip_of_control_strings(spark):
    texts: list[str] = []

    @settings(max_examples=300, database=None)
    @given(st.lists(pieces, max_size=8).map("".join))
    def collect(t):
        texts.append(t)

    collect()
    rows = [(i, j, j, "edit", ("user", "assistant")[j], t) for i, t in enumerate(texts) for j in range(2)]
    got = run(spark, rows)
    for i, t in enumerate(texts):
        assert [x.text for x in got[i].turns] == [t, t] and got[i].loss_texts == [t]
        for c in chat.Template().foreign:
            assert c not in got[i].formatted


def test_bad_template_and_empty(spark):
    with pytest.raises(ValueError):
        chat.Template(turn="<<x>>")
    assert run(spark, []) == {}
