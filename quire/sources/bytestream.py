"""A stored book as an ordered stream of its bytes, a part at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import live_indexes, manifest_of, parts_table, refresh


class LibraryError(Exception):
    """A request that can't be met, with a status: 400 no id, 404 no such book or nothing in it."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def book_bytes(spark: SparkSession, root: str, book_id: str, ahead: int = 1) -> Iterator[bytes]:
    """The bytes of a stored book in order, one part after the other.

    At most `ahead` parts are read before they are asked for, so a book of any size takes the room of ahead + 1 parts. Each
    read opens the book's bucket and, by the parts' order and statistics, little more than the part. Closing the iterator
    before its end cancels the reads under way; a read that fails ends it with the error.
    """
    if not book_id:
        raise LibraryError(400, "a book needs an id")
    found = live_indexes(spark, root).filter(F.col("book.id") == book_id).select(F.size("book.parts")).first()
    row = manifest_of(spark, root).filter(F.col("book_id") == book_id).select("batch").first()
    if found is None or row is None or found[0] < 1:
        raise LibraryError(404, f"no content of {book_id}")
    table, tag = parts_table(spark, root), f"book-{uuid.uuid4().hex}"
    refresh(spark, table)

    def read(number: int) -> bytes:
        spark.addTag(tag)
        try:
            part = spark.table(table).filter((F.col("book_id") == book_id) & (F.col("batch") == row[0]) & (F.col("part_no") == number)).select("content").first()
        finally:
            spark.removeTag(tag)
        if part is None:
            raise LibraryError(500, f"part {number} of {book_id} is missing")
        return bytes(part[0])

    def parts() -> Iterator[bytes]:
        with ThreadPoolExecutor(ahead) as pool:
            start = lambda n: pool.submit(inheritable_thread_target(spark)(read), n)
            waiting = [start(n) for n in range(1, min(ahead, found[0]) + 1)]
            try:
                for number in range(1, found[0] + 1):
                    content = waiting.pop(0).result()
                    if number + ahead <= found[0]:
                        waiting.append(start(number + ahead))
                    yield content
            finally:
                for x in waiting:
                    x.cancel()
                if waiting:
                    spark.interruptTag(tag)

    return parts()
