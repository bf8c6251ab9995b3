"""Line dedup: minimal perfect hashes over distinct line hashes, in shards, index counts that documents' lines probe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, small_side, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Line keys of a shard at most on average (17 bytes each in its arrays), and probes of a piece of it.
SHARD_KEYS = 100_000
PROBES = 400_000
#: Shards in more than one piece, of which the numbers are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000
#: Bits of the displacement hash per key, in the perfect hash's levels.
GAMMA = 1.5


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 hashed bits of each 64-bit key."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key's place is the rank of the first set bit that it alone hashes to, so n keys fill n places."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Over distinct unsigned 64-bit keys."""
        levels, rest = [], keys
        while len(rest):
            size = max(1, int(GAMMA * len(rest)))
            at = (mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int32))
            rest = rest[~alone[at]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where the key is surely not of the set."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (mix(keys[rest], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[rest[hit]] = self.before[i] + self.ranks[i][at[hit]]
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x.astype(bool)).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8).tolist(), 8 + 8 * n, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(np.int32))
            at += width
        return cls(levels)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's index from its distinct line hashes (a, b) with count and first document."""
    keys = pdf["a"].to_numpy().astype(np.uint64)
    unique, first = np.unique(keys, return_index=True)
    hashed = PerfectHash.of(unique)
    place = hashed.places(unique)
    prints, counts, firsts = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.uint8), np.zeros(len(unique), np.int64)
    prints[place], counts[place] = pdf["b"].to_numpy()[first], np.minimum(pdf["n"].to_numpy()[first], 255)
    firsts[place] = pdf["first"].to_numpy()[first]
    again = np.setdiff1d(np.arange(len(keys)), first)  # other lines with the same first half of the hash
    rest = pdf.iloc[again][["a", "b", "n", "first"]].to_numpy(np.int64)
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "hash": hashed.to_bytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "firsts": firsts.tobytes(), "rest": rest.tobytes()}])


class ShardIndex:
    """A shard's arrays as a task holds them: which probes name a line of another, smaller document."""

    def __init__(self, row: dict):
        self.hashed = PerfectHash.from_bytes(row["hash"])
        self.prints, self.counts, self.firsts = (np.frombuffer(row[k], t) for k, t in (("prints", np.int64), ("counts", np.uint8), ("firsts", np.int64)))
        self.rest = {(a, b): (n, f) for a, b, n, f in np.frombuffer(row["rest"], np.int64).reshape(-1, 4).tolist()}

    def lost(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = self.hashed.places(a.astype(np.uint64))
        own = (place >= 0) & (self.prints[place] == b)
        out = own & (self.counts[place] >= 2) & (self.firsts[place] != doc)
        if self.rest:
            for i in np.flatnonzero(~own).tolist():
                n, f = self.rest.get((int(a[i]), int(b[i])), (0, 0))
                out[i] = n >= 2 and f != doc[i]
        return out


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows by shard, each shard's arrays before its probes -> (doc_id, a, b): the line hashes that the document loses."""
    index = None
    for batch in batches:
        arrays = batch.column("arrays")
        heads = np.flatnonzero(arrays.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for head, end in zip([-1, *heads], [*heads, len(batch)], strict=True):
            if head >= 0:
                index = ShardIndex(arrays[head].as_py())
            if end > head + 1:
                doc, a, b = (batch.column(k).slice(head + 1, end - head - 1).to_numpy() for k in ("doc_id", "a", "b"))
                lost = index.lost(doc, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x[lost]) for x in (doc, a, b)], ["doc_id", "a", "b"])


def lost_lines(lines: DataFrame, shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """(doc_id, a, b) of the lines' hashes (the same columns) that two or more documents hold, but for the smallest doc_id.

    Shards have about `shard_keys` distinct lines. One with more than `probes` probes, as a very common line makes it, is
    cut into pieces by document: its arrays go to each piece. So arrays are sent once for many probes at any size of table.
    """
    keys = written(lines.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("held")), "line-keys")
    shard = F.pmod("a", F.lit(max(1, math.ceil(keys.count() / shard_keys)))).alias("shard")
    pieces = keys.groupBy(shard).agg(F.ceil(F.sum("held") / probes).alias("pieces")).filter("pieces > 1")
    pieces = small_side(written(pieces, "line-pieces"), BROADCAST_SHARDS)
    # the count array says how many documents hold the line: 1, or 2 for two or more
    rows = keys.select(shard, "a", "b", F.when(F.col("first") < F.col("last"), 2).otherwise(1).cast("long").alias("n"), "first")
    arrays = "hash binary, prints binary, counts binary, firsts binary, rest binary"
    index = rows.groupBy("shard").applyInPandas(build_shard, f"shard long, {arrays}").select("shard", F.struct("hash", "prints", "counts", "firsts", "rest").alias("arrays"))
    index = index.join(pieces, "shard", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    asked = lines.select(shard, "doc_id", "a", "b").join(pieces, "shard", "left").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1)))).drop("pieces")
    dealt = asked.unionByName(index, allowMissingColumns=True).repartition("shard", "piece")
    dealt = dealt.sortWithinPartitions("shard", F.col("arrays").isNull()).select("doc_id", "a", "b", "arrays")
    return dealt.mapInArrow(released(answer), "doc_id long, a long, b long")


def dedup_lines(docs: DataFrame, min_chars: int = 10, shard_keys: int = SHARD_KEYS, carry: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_lines, n_dropped, kept_text; with `carry` also original, a struct of the whole row.

    A line's key is `line_key`; keys of at least `min_chars` code points held by two or more documents lose all their
    lines except in the smallest doc_id that holds them. Keys are known by two 64-bit hashes: one indexes the shard's
    perfect hash, the other is the fingerprint. Probes follow their shard's arrays in the same task; one very common line
    is probed in many tasks (`lost_lines`).

    Null or empty text: one empty line. Null doc_id: the row stays whole and doesn't count. Rows with the same doc_id
    are parts of one document. Columns besides doc_id and text are ignored. Empty tables give an empty result.
    """
    ids, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit(""))
    found = docs.filter("doc_id is not null").select(ids, F.explode(F.split(text, "\n", -1)).alias("line")).select("doc_id", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lost = lost_lines(written(found.select("doc_id", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")), "lines"), shard_keys)
    # The hashes that a document loses, sorted, and the steps of a bisection over them: each line takes a few, however many lines and hashes there are.
    lost = lost.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("lost")).withColumn("steps", F.sequence(F.lit(1), F.length(F.bin(F.size("lost")))))
    # a carried row has the text already, which then goes through the join once
    if carry:
        split = docs.select(ids, F.struct("*").alias("original")).join(lost, "doc_id", "left").withColumn("text", F.coalesce("original.text", F.lit("")))
    else:
        split = docs.select(ids, text.alias("text")).join(lost, "doc_id", "left")
    some, lines = F.col("lost").isNotNull(), F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    probes = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.when(F.length(x["key"]) >= min_chars, F.struct(F.xxhash64(x["key"]).alias("a"), F.xxhash64(F.lit(1), x["key"]).alias("b"))).alias("hash")))

    def kept(x: Column) -> Column:
        """Whether the line's hash is none of those lost; the first that isn't less is at `low` when the bisection ends."""
        half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
        step = lambda s, _: F.when(s["low"] >= s["high"], s).when(F.get("lost", half(s)) < x["hash"], F.struct((half(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high")))
        low = F.aggregate("steps", F.struct(F.lit(0).alias("low"), F.size("lost").alias("high")), step, lambda s: s["low"])
        return x["hash"].isNull() | ~F.coalesce(F.get("lost", low) == x["hash"], F.lit(False))

    stay = F.transform(F.filter(probes, kept), lambda x: x["line"])
    split = split.withColumn("stay", F.when(some, stay))
    n = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    return split.select("doc_id", n.alias("n_lines"), F.when(some, n - F.size("stay")).otherwise(0).cast("long").alias("n_dropped"), F.when(some, F.array_join("stay", "\n")).otherwise(F.col("text")).alias("kept_text"), *["original"] * carry)
