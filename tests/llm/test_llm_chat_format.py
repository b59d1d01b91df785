import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierloom.llm.chat_format import format_chats, loss_text, merge_turns, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def test_layout(spark):
    rows = [(1, 0, "user", "How are you?"), (1, 2, "assistant", "And you?"), (1, 1, "assistant", "Well.")]
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert out.formatted == "### user:\nHow are you?</turn>\n### assistant:\nWell.</turn>\nAnd you?</turn>\n"
    assert "".join(s.text for s in out.segments) == out.formatted
    assert [s.text for s in out.segments if s.loss] == ["Well.", "And you?"]


TRICKY = st.text(st.sampled_from("\\<#:/blhc\n ]turn>é\U0001f600\x00"), max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), TRICKY, TRICKY), max_size=40))
def test_round_trip(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = format_chats(df).select("conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    want = {}
    for conv, turn, role, text in sorted(rows):
        want.setdefault(conv, []).append((role, text))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got.collect()} == want


def test_edge_cases(spark):
    rows = [
        (1, None, "user", "last"), (1, 5, None, None), (1, 5, "assistant", "b"), (1, 5, "assistant", "b"),
        (1, 5, "assistant", "a"), (None, 0, "assistant", ""), (2, 0, "assistant", "x" * 300_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)).withColumn("starts", F.lit(2)).withColumn("segments", F.lit(3))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in format_chats(df).select("conv_id", read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {
        1: [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b"), ("user", "last")],
        None: [("assistant", "")],
        2: [("assistant", "x" * 300_000)],
    }
    merged = {r.conv_id: [(m.role, len(m.texts)) for m in r.messages] for r in merge_turns(df).collect()}
    assert merged[1] == [("", 1), ("assistant", 3), ("user", 1)]
    assert format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    out = format_chats(rows).select(F.sha2(loss_text(F.col("segments")), 256).alias("h"), F.size(read_back(F.col("formatted"))).alias("n")).first()
    assert out.n == 20_000
    assert out.h == hashlib.sha256("".join(f"t{k}" for k in range(20_000) if k % 3).encode()).hexdigest()
