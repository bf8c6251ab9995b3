"""Tables in a folder, and the commit records that say which of them count.

A writer puts its tables in folders that carry the number of its commit, the one after the last. No reader knows them
before the record of that number lies in the folder `commits`, which is written elsewhere and moved there in one step.
What a writer that failed has left is overwritten by the next one, which has the same number.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting of the bytes that an Arrow batch holds at most, and what it is while tables are written.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python tasks get Arrow batches of at most BATCH_BYTES meanwhile."""
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, before)


class Store:
    """The folder `root`, in any store that Spark's Hadoop file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, place: str):
        return self._paths(f"{self.root}/{place}" if place else self.root)

    def place(self, table: str, number: int | str) -> str:
        return f"{self.root}/{table}/{number}"

    def children(self, place: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        path = self._path(place)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def make(self, place: str) -> None:
        """A folder, if there is none."""
        self._fs.mkdirs(self._path(place))

    def remove(self, places: list[str]) -> None:
        """Delete folders, several at a time; those that aren't there don't matter."""
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda p: self._fs.delete(self._path(p), True), places))

    def write(self, df: DataFrame, table: str, number: int | str, *by: str) -> DataFrame:
        """Write a table of a commit that is still to come, and read it back."""
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(self.place(table, number))
        return self.spark.read.schema(df.schema).parquet(self.place(table, number))

    def read(self, table: str, number: int | None, schema: str) -> DataFrame:
        """A table of a commit, or an empty one."""
        return self.spark.createDataFrame([], schema) if number is None else self.spark.read.schema(schema).parquet(self.place(table, number))

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.children("commits") if n.endswith(".json"))

    def record(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"commits/{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict:
        """The last record, with its number; number 0 before the first."""
        found = self.numbers()
        return {**self.record(found[-1]), "number": found[-1]} if found else {"number": 0}

    def commit(self, number: int, record: dict) -> None:
        """From now on the tables of `record` count. Fails if another writer has taken the number."""
        held = self._path(f"commits/.{number}-{uuid.uuid4().hex}")
        stream = self._fs.create(held, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        final = self._path(f"commits/{number}.json")
        if self._fs.exists(final) or not self._fs.rename(held, final):
            self._fs.delete(held, False)
            raise RuntimeError(f"commit {number} of {self.root} is taken by another writer")

    def forget(self, keep: int) -> None:
        """Drop all but the last `keep` records."""
        self.remove([f"commits/{n}.json" for n in self.numbers()[:-keep]])
