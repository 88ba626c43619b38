"""Long conversations: spans across pieces, many turns of one role, empty and very long texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import chat


def _digest(texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


@pytest.mark.parametrize("roles", [["user", "assistant"], ["assistant"], ["user", "assistant", "assistant", "assistant"]])
def test_many_turns(spark, roles):
    texts = [("é😀[x] </s> \\ " + str(i)) * (i % 7) for i in range(3000)]
    rows = [(1, i, roles[i % len(roles)], t) for i, t in enumerate(texts)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (got,) = chat.digest(made).collect()
    spoken = [t for _, _, role, t in rows if role == "assistant"]
    assert got["n_turns"] == 3000 and got["turns_sha256"] == _digest(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert (got["loss_chars"], got["loss_sha256"]) == (sum(map(len, spoken)), _digest(spoken))


def test_spans_at_the_borders_of_pieces(spark):
    head = len("<s>[INST]user[/INST]</s><s>[INST]assistant[/INST]")
    rows = [(n, turn, role, text) for n in range(chat.PIECE - head - 3, chat.PIECE - head + 4)
            for turn, (role, text) in enumerate([("user", "😀" * n), ("assistant", "b" * chat.PIECE), ("assistant", "")])]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in made.select(chat.loss_text(F.col("formatted"), F.col("loss")).alias("under"), "loss").collect():
        assert r["under"] == "b" * chat.PIECE and len(r["loss"]) == 2


def test_very_long_text(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "word < " * 1_000_000), (1, 2, "user", ""), (1, 3, "assistant", "end")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (got,) = chat.digest(made).collect()
    assert got["n_turns"] == 4 and got["loss_sha256"] == _digest(["word < " * 1_000_000, "end"])


def test_one_shuffle_and_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_conversations(turns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
