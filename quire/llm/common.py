"""Helpers shared by the training-data operators: tables, shared storage, byte-level word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python task holds at a time.
BATCH_BYTES = 8 << 20
#: Spark's setting of the bytes that an Arrow batch holds at most; tables are written with BATCH_BYTES.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder, by Spark's own reader (so any store that Spark reads will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all
    tasks run in this process (tests). A cluster without the setting has no such folder, which is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES meanwhile: both ends of a task's pipe hold one, and the JVM's grows by doubling."""
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what `written` has stored, once all that reads it is written itself."""
    for df in tables:
        path = getattr(df.sparkSession._jvm, "org.apache.hadoop.fs.Path")(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most_rows` rows; beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task function, which at its end gives freed memory back to the system: workers live on after their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` (binary or string) holds about `most` bytes in each; a longer row stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer file: in `folder`, or where the installed `public_tokenizers` package has it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
