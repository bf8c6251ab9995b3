"""Reading progress: entries, the most recently used books, history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Books that are remembered for a reader, and those that are shown.
KEPT, SHOWN = 20, 5
ENTRY = "bookId string, bookTitle string, author string, chapterId string, chapterTitle string, updatedAt double, scrollPosition bigint, bookHash string"


def read_entries(stored: DataFrame, now: Column) -> DataFrame:
    """Entries of `stored` (user_id, seq, json): user_id, seq, book_id, chapter_id, updated_at, scroll_position. Those without a book or chapter go; a missing time is `now`."""
    rows = stored.select("user_id", "seq", F.from_json("json", ENTRY).alias("e")).filter("e.bookId is not null and e.chapterId is not null")
    return rows.select("user_id", "seq", F.col("e.bookId").alias("book_id"), F.col("e.chapterId").alias("chapter_id"), F.coalesce(F.timestamp_millis(F.col("e.updatedAt").cast("long")), now).alias("updated_at"), F.col("e.scrollPosition").alias("scroll_position"))


def latest(saves: DataFrame) -> DataFrame:
    """The last save (by updated_at, then seq) of every reader's book: a combining aggregation, so a busy reader costs no sort."""
    rest = [c for c in saves.columns if c not in ("user_id", "book_id")]
    return saves.groupBy("user_id", "book_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("x")).select("user_id", "book_id", "x.*")


def most_recent(saves: DataFrame, most: int = KEPT) -> DataFrame:
    """Each reader's `most` books of the latest saves, with place (from 1). One pass gives what saving one by one does: a forgotten book comes back by a later save only."""
    by = W.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("seq"))
    return latest(saves).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)


def books_with_progress(books: DataFrame, saves: DataFrame) -> DataFrame:
    """`books` (book_id, ...) with the number of readers and the latest entry of each, a struct of the save's columns; books nobody reads stay."""
    rest = [c for c in saves.columns if c != "book_id"]
    last = saves.groupBy("book_id").agg(F.count_distinct("user_id").alias("readers"), F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("entry"))
    return books.join(last, "book_id", "left").withColumn("readers", F.coalesce("readers", F.lit(0)))


def entries_of(asked: DataFrame, saves: DataFrame) -> DataFrame:
    """For each of `asked` (user_id, book_id) the reader's latest save of the book, all its columns; nulls where there is none."""
    return asked.join(latest(saves), ["user_id", "book_id"], "left")


def saved(entries: DataFrame, now: Column) -> DataFrame:
    """`entries` as they are saved: with the time of saving, whatever time they had."""
    return entries.withColumn("updated_at", now)


def settled(values: DataFrame, key: str, millis: str, then: str, delay: int = 250) -> DataFrame:
    """Of `values` those that no other of the same key follows within `delay` milliseconds; of equal times the greater `then` is later."""
    after = F.lead(millis).over(W.partitionBy(key).orderBy(millis, then))
    return values.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") - F.col(millis) >= delay)).drop("_after")


def moved(scrolls: DataFrame, least: int = 100) -> DataFrame:
    """Of `scrolls` (user_id, book_id, seq, position) those over `least` away from the reader's last kept one in the book, which is 0 at first.

    Rows stream by reader and book in order, so a task holds one kept place, however much a reader scrolls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, 0
        for batch in batches:
            kept = []
            for i, (user, book, at) in enumerate(zip(*(batch[c].to_pylist() for c in ("user_id", "book_id", "position")), strict=True)):
                if (user, book) != of:
                    of, last = (user, book), 0
                if at is not None and abs(at - last) > least:
                    last = at
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = scrolls.select("user_id", "book_id", "seq", "position")
    return rows.repartition("user_id", "book_id").sortWithinPartitions("user_id", "book_id", "seq").mapInArrow(run, rows.schema)
