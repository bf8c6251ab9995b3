"""Chat formatting by prefix-target expansion: every assistant turn is an example whose context is all turns before it.

A turn is written as `<|role|>text</s>`. Texts and roles are escaped, so that no `<`, `[` or `|` of theirs is left and
no control string can be read out of them; the backslash makes that reversible. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The characters of control strings, and what they become inside texts; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
OPEN, MID, CLOSE = "<|", "|>", "</s>"


def escape(text: Column) -> Column:
    """`text` without the characters that control strings start with."""
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """What `escape` was given."""

    def part(x: Column) -> Column:
        for raw, safe in ESCAPES[1:]:
            x = F.replace(x, F.lit(safe), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_conversations(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text): conv_id, formatted, examples.

    `formatted` holds all turns once. `examples` has an entry per turn with role `target`, in order: context_turns and
    context_chars (all turns before it, which are the first so many characters of `formatted`), mask_start and mask_chars
    (where in `formatted` its text stands, which alone is trained), chars (of the whole example). Turns after the last
    target make a last entry with a null mask, which trains nothing. Contexts are kept as lengths here; `expand`
    makes the rows of examples, each with the text of all turns before it.

    Turns with the same number are ordered by role, then text; a null number comes first. Null text and null role:
    empty. Rows with null conv_id are one conversation. Repeated rows are turns of their own. Columns besides these four
    are ignored. An empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", escape(F.col("text")).alias("target")).select("*", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), "target", F.lit(CLOSE)).alias("piece"))
    by = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", "target", "piece", F.row_number().over(by).alias("pos"), F.sum(F.length("piece")).over(by.rowsBetween(W.unboundedPreceding, 0)).alias("end"))
    rows = rows.withColumn("hit", F.col("role") == target)
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct((F.col("pos") - 1).alias("context_turns"), (F.col("end") - F.length("piece")).alias("context_chars"), (F.col("end") - F.length("target") - len(CLOSE)).alias("mask_start"), F.length("target").cast("long").alias("mask_chars"), F.col("end").alias("chars"))))).alias("examples"),
        F.max(F.when(F.col("hit"), F.col("pos"))).alias("last_hit"), F.max("pos").alias("last"), F.max("end").alias("chars"))
    rest = F.expr("if(coalesce(last_hit, 0) < last, array(named_struct('context_turns', last, 'context_chars', chars, 'mask_start', cast(null as bigint), 'mask_chars', cast(null as bigint), 'chars', chars)), array())")
    return whole.select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"), F.concat("examples", rest).alias("examples"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example of `format_conversations`, prefix and target spelt out: conv_id, example (from 1), context_turns, context_chars, mask_start, mask_chars, chars, conversation (the example's text: all turns before it, then its own), completion (escaped, read from that text under the mask; null if it trains nothing).

    The rows are made one after the other, so a task holds one example's text besides its conversation.
    """
    rows = formatted.select("conv_id", "formatted", F.posexplode("examples").alias("i", "x"))
    rows = rows.select("conv_id", (F.col("i") + 1).alias("example"), "x.*", F.substr("formatted", F.lit(1), F.col("x.chars").cast("int")).alias("conversation"))
    under = F.substr("conversation", (F.col("mask_start") + 1).cast("int"), F.col("mask_chars").cast("int"))
    return rows.withColumn("completion", under)


def example_texts(formatted: DataFrame) -> DataFrame:
    """One row per example of `format_conversations`, spelt out: conv_id, example (from 1), text, mask_start, mask_chars."""
    return expand(formatted).select("conv_id", "example", F.col("conversation").alias("text"), "mask_start", "mask_chars")


def read_back(expanded: DataFrame) -> DataFrame:
    """Of the examples of each conversation (`expand`): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the texts of its examples (the longest is the whole conversation) and their masks alone. Rows stay where the formatting has put them."""
    rows = expanded.groupBy("conv_id").agg(F.max_by("conversation", "chars").alias("formatted"), F.sort_array(F.collect_list(F.when(F.col("completion").isNotNull(), F.struct("example", "completion")))).alias("trained"), F.sum(F.length("conversation")).cast("long").alias("formatted_chars"))
    parts = F.expr(f"filter(split(formatted, '{CLOSE}', -1), x -> x <> '')")

    def turn(x: Column) -> Column:
        head = F.substring_index(x, MID, 1)
        return F.concat(unescape(F.substr(head, F.lit(len(OPEN) + 1))), F.lit("\n"), unescape(F.substr(x, F.length(head) + len(MID) + 1)), F.lit("\n"))

    loss = F.array_join(F.transform("trained", lambda x: unescape(x["completion"])), "")
    out = rows.select("conv_id", parts.alias("parts"), loss.alias("loss"), "formatted_chars")
    return out.select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("parts", turn), ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
