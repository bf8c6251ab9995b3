"""Files of a library: archives and their members, JSON documents, parts."""

from __future__ import annotations

import contextlib
import ctypes
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.encoding import text_of
from ..functions.text import BLANK, trimmed

#: Bytes that a Python task gathers before it hands them on.
STEP_BYTES = 4 << 20
Members = Iterator[tuple[str, bool, bytes]]


def scan_archives(spark: SparkSession, folder: str, glob: str = "*.[rR][aA][rR]", names: list[str] | None = None) -> DataFrame:
    """(filename, length, content) of a folder's archives; with `names`, of these alone, so that no other is opened."""
    if names == []:
        return spark.createDataFrame([], "filename string, length bigint, content binary")
    plain = lambda n: re.sub(r"([][{}*?])", r"\\\1", n)  # noqa: E731  names are no patterns
    places = folder if names is None else [f"{folder.rstrip('/')}/{plain(n)}" for n in names]
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(places)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def zip_members(data: bytes) -> Members:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            yield m.filename, m.is_dir(), b"" if m.is_dir() else z.read(m)


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def members_of(archives: DataFrame, extract: Callable[[bytes], Members] = zip_members) -> DataFrame:
    """(filename, member_pos, member_name, is_dir, content) of `archives` (filename, content). Formats plug in as `extract`; a file that it can't open has no members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("filename", pa.string()), ("member_pos", pa.int32()), ("member_name", pa.string()), ("is_dir", pa.bool_()), ("content", pa.binary())])
        for batch in batches:
            rows, held = [], 0
            for name, data in zip(batch["filename"], batch["content"], strict=True):
                with contextlib.suppress(zipfile.BadZipFile, OSError):
                    found = [{"filename": name.as_py(), "member_pos": i, "member_name": m, "is_dir": d, "content": x} for i, (m, d, x) in enumerate(extract(data.as_py() or b""))]
                    rows += found
                    held += sum(len(x["content"]) for x in found)
                if held > STEP_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, fields)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, fields)
        give_back()

    return archives.select("filename", "content").mapInArrow(run, "filename string, member_pos int, member_name string, is_dir boolean, content binary")


def first_texts(archives: DataFrame, extract: Callable[[bytes], Members] = zip_members) -> DataFrame:
    """`archives` (..., content) whose first .txt member that isn't blank has a place: their other columns and text, that member decoded and trimmed.

    A task holds the members of one archive at a time. A file that `extract` can't open has no members.
    """
    rest = [c for c in archives.columns if c != "content"]
    blank = re.compile(f"{BLANK}*")

    def first(data: bytes) -> str | None:
        found = None
        try:
            for name, folder, content in extract(data):
                if found is None and not folder and name.lower().endswith(".txt") and not blank.fullmatch(text := text_of(content)):
                    found = text
        except (zipfile.BadZipFile, OSError):
            return None
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(rest)
            at, texts, held = [], [], 0
            for i, data in enumerate(batch["content"]):
                text = first(data.as_py() or b"")
                if text is not None:
                    at.append(i)
                    texts.append(text)
                    held += len(text)
                if held > STEP_BYTES or (at and i == batch.num_rows - 1):
                    kept = own.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], [*rest, "text"])
                    at, texts, held = [], [], 0
        give_back()

    rows = archives.select(*rest, "content")
    schema = StructType([*rows.drop("content").schema.fields, StructField("text", StringType())])
    return rows.mapInArrow(run, schema).withColumn("text", trimmed(F.col("text")))


def safe_names(members: DataFrame) -> DataFrame:
    """`members` (filename, member_pos from 0, member_name, ...) with safe_name: the last step of the path that isn't blank or dots,
    runs of odd characters as one `_`; entry_N for the N-th member where nothing is left; _1, _2, ... after repeated names of an archive.
    """
    steps = F.filter(F.split(F.replace("member_name", F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))
    base = F.regexp_replace(F.coalesce(F.try_element_at(steps, F.lit(-1)), F.concat(F.lit("entry_"), F.col("member_pos").cast("string"))), r"[^a-zA-Z0-9一-龥._-]+", "_")
    rows = members.withColumn("_base", base)
    again = F.row_number().over(W.partitionBy("filename", "_base").orderBy("member_pos")) - 1
    return rows.withColumn("safe_name", F.when(again > 0, F.concat("_base", F.lit("_"), again.cast("string"))).otherwise(F.col("_base"))).drop("_base")


def first_text(members: DataFrame, text: str = "text") -> DataFrame:
    """(filename, text): each archive's first .txt member that isn't blank. `members` has `text`, the decoded content."""
    rows = members.filter(~F.col("is_dir") & F.lower("member_name").endswith(".txt") & (trimmed(F.col(text)) != ""))
    return rows.groupBy("filename").agg(F.min_by(text, "member_pos").alias("text"))


def read_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document by schema; an empty table if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).option("multiLine", True).json(path) if there else spark.createDataFrame([], schema)
