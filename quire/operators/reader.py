"""Byte windows over parts, and how a reader's window moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import joined

# Bytes of a step of the window, and the steps that it holds.
STEP, STEPS = 100_000, 3


def read_windows(windows: DataFrame, parts: DataFrame) -> DataFrame:
    """(window_id, book_id, start_byte, length, n_parts, content) for `windows` (window_id, book_id, start_byte, length).

    `parts` (book_id, part_no, start_byte, size, content). Windows meet the parts they overlap by an equi join on the
    book with an interval condition; lengths are clipped to the book. Null ids, negative starts and lengths under 1 give
    no row, and so do windows past the end.
    """
    w = windows.filter("book_id is not null and start_byte >= 0 and length > 0").select("window_id", F.col("book_id").alias("b"), F.col("start_byte").alias("s"), (F.col("start_byte") + F.col("length")).alias("e"), "length")
    p = parts.select("book_id", "part_no", "start_byte", "content", (F.col("start_byte") + F.octet_length("content")).alias("end_byte"))
    hits = w.join(p, (F.col("b") == F.col("book_id")) & (F.col("s") < F.col("end_byte")) & (F.col("e") > F.col("start_byte")))
    piece = F.expr("substring(content, cast(greatest(s - start_byte, 0) + 1 as int), cast(least(e, end_byte) - greatest(s, start_byte) as int))")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("part_no", piece.alias("x")))), lambda x: x["x"])
    out = hits.groupBy("window_id", "b", "s", "length").agg(F.count("*").alias("n_parts"), joined(listed).alias("content"))
    return out.select("window_id", F.col("b").alias("book_id"), F.col("s").alias("start_byte"), "length", "n_parts", "content")


def lenient_text(content: Column) -> Column:
    """Text of bytes that may begin or end inside a character, without a byte-order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def restored(saved: Column, total: Column) -> Column:
    """Window (s, e) around a saved place; the first step where none is saved."""
    some = saved > 0
    return F.struct(F.when(some, F.greatest(saved - STEP, F.lit(0))).otherwise(0).cast("long").alias("s"), F.when(some, F.least(saved + STEP, total)).otherwise(F.least(F.lit(STEP), total)).cast("long").alias("e"))


def moved(window: Column, moves: Column, total: Column) -> Column:
    """Window (s, e) after an array of moves 'down' and 'up', one step each; at most STEPS steps are held."""

    def step(w: Column, move: Column) -> Column:
        full = F.ceil((w["e"] - w["s"]) / STEP) >= STEPS
        down = F.struct(F.when(full, w["s"] + STEP).otherwise(w["s"]).alias("s"), F.least(w["e"] + STEP, total).cast("long").alias("e"))
        up = F.struct(F.greatest(w["s"] - STEP, F.lit(0)).cast("long").alias("s"), F.when(full, w["e"] - STEP).otherwise(w["e"]).alias("e"))
        return F.when(move == "down", down).when(move == "up", up).otherwise(w)

    return F.aggregate(moves, window, step)


def progress_byte(window: Column, scrolled: Column, height: Column) -> Column:
    """Place in the text of a scroll position inside a window."""
    return F.floor(window["s"] + (window["e"] - window["s"]) * scrolled / F.when(height == 0, 1).otherwise(height)).cast("long")


def relative_place(saved: Column, window: Column) -> Column:
    """Share of the window that lies before a saved place; null if it isn't in it."""
    return F.when((saved > 0) & (saved >= window["s"]) & (window["e"] > window["s"]), (saved - window["s"]) / (window["e"] - window["s"]))
