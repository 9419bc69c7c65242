"""Rows with a shared or missing key are not lost."""

from __future__ import annotations

from reportmill.llm import chat
from reportmill.llm import near_dup as N


def test_one_id_with_two_texts(spark):
    long, other = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    rows = [(3, long, "a"), (5, long + " tail", "b"), (5, "clean text of five words here", "c"), (7, other, "d"), (7, other + " tail", "e"), (None, "without an id", "f"), (8, "alone", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    left = N.deduplicated(df)
    assert left.columns == df.columns
    got = left.collect()
    tags = sorted(r.tag for r in got)
    assert tags in (["a", "c", "d", "f", "g"], ["a", "c", "e", "f", "g"])
    assert {(r.doc_id, r.text, r.tag) for r in got} <= set(rows)


def test_conversation_without_an_id(spark):
    df = spark.createDataFrame([(None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.tree: [t.text for t in r.turns] for r in chat.chosen_paths(chat.conversation_messages(df)).select("tree", chat.parsed("formatted").alias("turns")).collect()}
    assert got == {None: ["q", "a"], 1: ["x"]}
