"""Prefix-target expansion: every example holds the text of all turns before its target."""

from pyspark.sql import functions as F
from quire.llm.chat_format import CLOSE, MID, OPEN, expand, format_conversations, read_back


def test_each_example_holds_its_prefix_and_target(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"é{i}") for i in range(7)]
    piece = lambda role, text: f"{OPEN}{role}{MID}{text}{CLOSE}"
    out = expand(format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    found = {r.example: r for r in out.collect()}
    for i, n in ((1, 2), (2, 4), (3, 6), (4, 7)):
        assert found[i].conversation == "".join(piece(role, text) for _, _, role, text in turns[:n])
    assert [found[i].completion for i in (1, 2, 3, 4)] == ["é1", "é3", "é5", None]
    lost = out.withColumn("conversation", F.when(F.col("example") == 1, F.col("conversation")))  # prefixes are read, not lengths
    whole, cut = read_back(out).first(), read_back(lost).first()
    assert whole.n_turns == 7 and whole.formatted_chars == sum(len(found[i].conversation) for i in found) != cut.formatted_chars
