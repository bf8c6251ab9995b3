"""Token counts by separator scan: documents in flat token files are found by their end-of-document ids alone.

A file is a run of fixed-width ids without an index, read as blocks. Every block is searched on its own with one vector
comparison; a document that spans blocks is stitched by a prefix scan over the blocks' summaries (ids, separators, place
of the last separator), in two levels so that no window holds all blocks of a large file.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, tokenizer_path, written

SEPARATOR = 50256
BLOCK_IDS = 1 << 18
#: Blocks that one window of the lower level of the scan holds.
SUPER = 1024
#: Bytes of a token file that is read as a whole.
WHOLE = 256 << 20


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Byte-level BPE from a file of ranks. The split pattern is the published one of this vocabulary."""
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_files(docs: DataFrame, ranks: str, block_ids: int = BLOCK_IDS, separator: int = SEPARATOR) -> DataFrame:
    """Flat token files in the shared folder, one per partition of `docs` (doc_id, text): file, block, ids (unsigned
    16-bit), names (documents that end in the block, which stand in for a list of names kept beside a file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, block, held, count, names = encoder(ranks).encode_ordinary, TaskContext.get().partitionId(), 0, [], 0, []
        fields = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("names", pa.list_(pa.int64()))])
        ends: list[tuple[int, int | None]] = []  # ids up to the separator of a document, and its name

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, block, ends
            flat = np.concatenate(held) if held else np.zeros(0, np.uint16)
            at = 0
            while len(flat) - at >= block_ids or (last and at < len(flat)):
                to = min(at + block_ids, len(flat))
                names = [x for e, x in ends if e <= to]
                yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "ids": flat[at:to].tobytes(), "names": names}], fields)
                ends = [(e, x) for e, x in ends if e > to]
                block, at = block + 1, to
            held, count, ends = [flat[at:]], len(flat) - at, [(e - at, x) for e, x in ends]

        for batch in byte_slices(batches, "text", 1 << 20):
            for doc, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                held.append(np.array([*encode(text.decode("utf-8", "replace")), separator], np.uint16))
                count += len(held[-1])
                ends.append((count, doc))
            if count >= block_ids:
                yield from blocks(False)
        yield from blocks(True)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file long, block long, ids binary, names array<long>"), "token-files")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS, whole: int = WHOLE) -> DataFrame:
    """Blocks of the flat token files under `path`: file, block, ids.

    Files of up to `whole` bytes are opened by Spark, from any store that it reads, and cut in the task. Tasks read ranges
    of larger ones, which may exceed memory; their store must be one that Arrow knows.
    """
    files = spark.read.format("binaryFile").load(path)
    size = width * block_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "content"):
            for file, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                data = content.as_buffer()
                for block in range(max(1, -(-len(data) // size))):
                    part = data[block * size : (block + 1) * size] if len(data) else b""
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([bytes(part)], pa.binary())], ["file", "block", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for r in batch.to_pylist():
                store, inner = FileSystem.from_uri(r["path"])
                with store.open_input_file(inner) as f:
                    out = f.read_at(size, r["block"] * size)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["block"]]), pa.array([out], pa.binary())], ["file", "block", "ids"])

    schema = "file long, block long, ids binary"
    small = files.filter(F.col("length") <= whole).select(F.xxhash64("path").alias("file"), "content").mapInArrow(cut, schema)
    large = files.select("path", "length").filter(F.col("length") > whole).select(F.xxhash64("path").alias("file"), "path", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("block"))
    return small.union(large.repartition(F.col("file"), F.col("block")).mapInArrow(run, schema))


def separator_scan(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2, names: bool = False) -> DataFrame:
    """One row per document of the files whose `blocks` (file, block, ids) these are: file, ordinal (from 0), start (ids before it), n_tokens (without the separator), closed.

    What follows the last separator of a file, if anything, is a document with closed false. With `names` the blocks
    carry names of the documents that end in them, and rows get `name` (null if open). A null or empty block holds no
    ids. Empty tables give an empty result. Other columns are ignored.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "ids"):
            at, counts = [], []
            for x in batch["ids"].to_pylist():
                ids = np.frombuffer(x or b"", kind)
                at.append(np.flatnonzero(ids == separator))
                counts.append(len(ids))
            cols = [batch["file"], batch["block"], pa.array(counts, pa.int64()), pa.array(at, pa.list_(pa.int64())), *([batch["names"]] if names else [])]
            yield pa.RecordBatch.from_arrays(cols, ["file", "block", "n", "at"] + ["names"] * names)

    found = blocks.select(F.col("file").cast("long"), F.col("block").cast("long"), "ids", *["names"] * names).mapInArrow(run, "file long, block long, n long, at array<long>" + ", names array<long>" * names)
    found = written(found.withColumn("upper", F.floor(F.col("block") / SUPER)), "separators")
    before = W.partitionBy("file", "upper").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    low = found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("seps", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)))
    low = low.withColumn("own_last", F.when(F.size("at") > 0, F.col("start") + F.try_element_at("at", F.lit(-1)))).withColumn("last", F.max("own_last").over(before))
    over = W.partitionBy("file").orderBy("upper").rowsBetween(W.unboundedPreceding, -1)
    high = low.groupBy("file", "upper").agg(F.sum("n").alias("n"), F.sum(F.size("at")).alias("s"), F.max("own_last").alias("l"))
    high = high.withColumn("start0", F.coalesce(F.sum("n").over(over), F.lit(0))).withColumn("seps0", F.coalesce(F.sum("s").over(over), F.lit(0)))
    high = high.withColumn("last_abs", F.col("start0") + F.col("l"))
    rows = low.join(high.select("file", "upper", "start0", "seps0", F.max("last_abs").over(over).alias("last0")), ["file", "upper"])
    rows = rows.select("file", "at", *["names"] * names, (F.col("start0") + F.col("start")).alias("start"), (F.col("seps0") + F.col("seps")).alias("seps"), F.coalesce(F.col("start0") + F.col("last"), "last0", F.lit(-1)).alias("last"))
    docs = rows.select("*", F.posexplode("at").alias("i", "sep"))
    begin = F.when(F.col("i") == 0, F.col("last") + 1).otherwise(F.col("start") + F.try_element_at("at", F.col("i")) + 1)
    name = [F.try_element_at("names", F.col("i") + 1).alias("name")] * names
    docs = docs.select("file", (F.col("seps") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("start") + F.col("sep") - begin).alias("n_tokens"), F.lit(True).alias("closed"), *name)
    total = high.groupBy("file").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.coalesce(F.max("last_abs"), F.lit(-1)).alias("l"))
    rest = total.filter("n > l + 1").select("file", F.col("s").alias("ordinal"), (F.col("l") + 1).alias("start"), (F.col("n") - F.col("l") - 1).alias("n_tokens"), F.lit(False).alias("closed"), *[F.lit(None).cast("long").alias("name")] * names)
    return docs.union(rest)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_tokens, from flat token files that hold all of them.

    Null or empty text: 0 tokens. Null doc_id and repeated rows: a row each. Other columns are ignored. Empty tables
    give an empty result.
    """
    blocks = token_files(docs, tokenizer_path(tokenizer, folder), block_ids)
    return separator_scan(blocks, names=True).select(F.col("name").alias("doc_id"), "n_tokens")
