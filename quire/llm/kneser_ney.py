"""Interpolated modified Kneser-Ney bigram models of words, counted by Spark and kept in sharded sorted arrays.

A word is a run `[^\\x20\\x09-\\x0D]+`. Words in the vocabulary of a language, the sorted hashes of the words that
most documents hold, are tokens of their own; all others are one of some 200 tokens by shape (letters, digits, symbols,
capitals, length). An event is a token after the one before it, or after the start of the document, so it crosses the
ends of words, and its key packs both tokens into 32 bits: no keys collide, and sorted keys pack into one or two bytes.

Rows of packed arrays travel, not events. `count_bigrams` combines events in tasks and merges them by key range (shard);
the lower order is a few numbers a token, which `train` adds up over the shards. For scores, tasks deal the events of a
unit of documents to the shards, whose sorted arrays answer with a sum for each document; the sums of a unit meet in one
row. Counts are kept in two folds by a hash of the text, and a document is scored by the fold that it isn't in, so no
document, nor a copy of it, is judged by a model that has read it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, forget, released, written

#: Tokens of a language: its start, shapes from 1, and up to so many words from FIRST.
FIRST, VOCABULARY = 256, 65_280
TOKENS = FIRST + VOCABULARY
#: Bits of the hashes of words: a word outside a vocabulary passes for one in it with a chance of 65,280 in 2^48.
WORD_BITS = 48
#: Languages whose vocabularies and lower orders are held at a time; where there are more, others follow in further passes.
LANGUAGES = 64
#: Words that a task counts at a time, and events that it packs at a time.
MEMO_WORDS, UNIT_EVENTS, UNIT_DOCS = 250_000, 1_000_000, 60_000
#: Bytes of text that are split into words at a time; word objects take several times as much.
TEXT_BYTES = 3 << 20
#: Events of a shard on average, shards at most, and events of a shard that one task answers.
SHARD_EVENTS, SHARDS, SALT_EVENTS = 4_000_000, 256, 64_000_000
#: Tokens of the lower order that one row holds.
SLICE = 4096
SPREAD, GATHER = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)
DIGIT, MARK = re.compile(rb"[0-9]").search, re.compile(rb"[!-/:-@\[-`{-~]").search


def shape(word: bytes) -> int:
    """Token of a word outside the vocabulary, from 1 to 192."""
    core = word.rstrip(b".,;:!?)\"'").lstrip(b"(\"'")
    low = core.lower()
    caps = 0 if core == low else 2 if len(core) > 1 and core == core.upper() else 1
    n = len(core)
    out = caps + 3 * (0 if n <= 3 else 1 if n <= 7 else 2 if n <= 12 else 3)
    for flag in (DIGIT(core), MARK(core), not core.isascii(), low == core.upper()):
        out = 2 * out + bool(flag)
    return out + 1


def tokens_of(texts: list[list[bytes]], vocabulary: np.ndarray) -> np.ndarray:
    """Tokens of all words of the texts, one after the other."""
    distinct = list(set(chain.from_iterable(texts)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)) >> np.uint64(64 - WORD_BITS)
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
    known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(distinct), bool)
    at += FIRST
    for i in np.flatnonzero(~known).tolist():
        at[i] = shape(distinct[i])
    table = dict(zip(distinct, at.tolist(), strict=True))
    return np.fromiter(map(table.__getitem__, chain.from_iterable(texts)), np.uint32, sum(map(len, texts)))


def events_of(texts: list[list[bytes]], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spread keys of all events of the texts, and the number of events of each."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    tokens = tokens_of(texts, vocabulary)
    before = np.zeros(len(tokens), np.uint32)
    before[1:] = tokens[:-1]
    starts = np.cumsum(counts) - counts
    before[starts[counts > 0]] = 0
    with np.errstate(over="ignore"):
        return (before << np.uint32(16) | tokens) * np.uint32(SPREAD), counts


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """An array of unsigned numbers, as differences if it rises, byte plane by byte plane."""
    if rising and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def row_key(doc_id: str | Column, lang: str | Column, text: str | Column) -> Column:
    """A hash that tells rows apart: of the document's id, language and text, each null or not."""
    return F.xxhash64(F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id.cast("long"), F.coalesce(lang, F.lit("")), text)


def prepared(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lang ('' for null), text, fold and row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), "text", *more)
    return rows.withColumn("fold", F.pmod(F.shiftright(F.xxhash64("text"), 9), F.lit(2)).cast("int")).withColumn("row", row_key("doc_id", "lang", "text"))


def grouped(keys: list) -> dict:
    """Places of each distinct key."""
    out: dict = {}
    for i, k in enumerate(keys):
        out.setdefault(k, []).append(i)
    return out


def fitting(fit: Callable | None, *columns: list) -> list[list]:
    """Columns, of which the last holds texts, but for the rows whose text isn't fit for training."""
    if fit is None:
        return list(columns)
    chosen = fit(columns[-1])
    return [list(compress(c, chosen)) for c in columns]


def vocabularies(docs: DataFrame, most: int = VOCABULARY, fit: Callable | None = None) -> tuple[dict[str, np.ndarray], int]:
    """The vocabulary of each language of `docs` (lang, text), and the number of all words.

    Words of two documents or more are in it, from the most frequent on, as long as all with the same number of documents
    (from 64 on rounded to a sixteenth of a power of two) fit: `most` hashes a language. `document_scores` asks for at
    most LANGUAGES languages at a time.
    """

    cuts = np.array([s << (WORD_BITS - 6) for s in range(1, 64)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        total: Counter = Counter()

        def flush(lang: str, words: Counter) -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - WORD_BITS)
            order = np.argsort(h)
            h, n = h[order], np.fromiter(words.values(), np.uint64, len(words))[order]
            at = [0, *np.searchsorted(h, cuts).tolist(), len(h)]
            rows = [(lang, s, packed(h[a:b], True), packed(n[a:b])) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            rows.append((lang, -1, packed(np.zeros(1, np.uint64), True), packed(np.array([total.pop(lang)], np.uint64))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "shard", "keys", "counts"])

        for batch in byte_slices(batches, "text", TEXT_BYTES):
            for lang, text in zip(*fitting(fit, batch["lang"].to_pylist(), as_bytes(batch["text"])), strict=True):
                words = text.split()
                total[lang] += len(words)
                seen.setdefault(lang, Counter()).update(set(words))
            if sum(map(len, seen.values())) > MEMO_WORDS:
                for lang in list(seen):
                    yield flush(lang, seen.pop(lang))
        for lang, words in seen.items():
            yield flush(lang, words)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, shard), keys, counts in merged_rows(batches, ("lang", "shard"), np.uint64):
            often = (counts > 1) | (shard < 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * int(often.sum()), pa.string()), pa.array([shard] * int(often.sum()), pa.int32()), pa.array(keys[often].view(np.int64)), pa.array(counts[often].view(np.int64))], ["lang", "shard", "h", "n"])

    rows = docs.select("lang", "text").mapInArrow(released(count), "lang string, shard int, keys binary, counts binary").repartition("lang", "shard").sortWithinPartitions("lang", "shard")
    rows = written(rows.mapInArrow(released(merge), "lang string, shard int, h long, n long"), "words")
    totals = {r[0]: r[1] for r in rows.filter("shard < 0").select("lang", "n").collect()}
    words = rows.filter(F.col("lang").isin(*totals) & (F.col("shard") >= 0)) if totals else rows.limit(0)
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16).cast("long") - 32)  # 64 documents: step 64
    steps: dict[str, list] = {}
    for lang, at, n in words.groupBy("lang", step.alias("step")).count().orderBy(F.desc("step")).collect():
        steps.setdefault(lang, []).append((at, n))
    least = {}
    for lang, rising in steps.items():
        held = 0
        for at, n in rising:
            held += n
            if held > most:
                break
            least[lang] = at
    found: dict[str, np.ndarray] = {lang: np.zeros(0, np.uint64) for lang in totals}
    if least:
        chosen = words.filter(step >= F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("lang")]).select("lang", "h").toArrow()
        langs, hashes = np.array(chosen["lang"].to_pylist(), object), chosen["h"].to_numpy().view(np.uint64)
        for lang in least:
            found[lang] = np.sort(hashes[langs == lang])
    forget(rows)
    return found, sum(totals.values())


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged_rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], kind: type) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Of rows (names, keys, counts) that come sorted by `names`: each group's distinct keys and sums of counts. A group is merged as it comes, so it takes the room of its distinct keys."""
    last, parts, fresh = None, [], 0
    for batch in batches:
        for *of, keys, counts in zip(*(batch[n].to_pylist() for n in (*names, "keys", "counts")), strict=True):
            if of != last and last is not None:
                yield tuple(last), *merged(parts)
                parts, fresh = [], 0
            last = of
            parts.append((unpacked(keys, kind, True), unpacked(counts, np.uint64)))
            fresh += len(parts[-1][0])
            if fresh > max(2 * SHARD_EVENTS, len(parts[0][0])):
                parts, fresh = [merged(parts)], 0
    if last is not None:
        yield tuple(last), *merged(parts)


def bounds(shards: int) -> np.ndarray:
    """First spread key of each shard but the first one."""
    return np.array([-(-(s << 32) // shards) for s in range(1, shards)], np.uint64)


COUNTS = "lang string, shard int, salt int, fold int, keys binary, counts binary"


def count_bigrams(docs: DataFrame, sent, shards: int, salts: int, fit: Callable | None = None) -> DataFrame:
    """(lang, shard, k0, c0, k1, c1): sorted spread keys of the events of `docs` (`prepared`) and their counts, by fold.

    A key range holds 2^32 / `shards` keys at most, so however large the corpus, a merge ends with a bounded array.
    """
    cuts = bounds(shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        number = 0

        def flush(lang: str, fold: int, keys: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            keys, counts = np.unique(keys, return_counts=True)
            at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
            rows = [(lang, s, number % salts, fold, packed(keys[a:b], True), packed(counts[a:b].astype(np.uint64))) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "shard", "salt", "fold", "keys", "counts"])

        for batch in byte_slices(batches, "text", TEXT_BYTES):
            langs, folds, texts = fitting(fit, batch["lang"].to_pylist(), batch["fold"].to_pylist(), as_bytes(batch["text"]))
            texts = [t.split() for t in texts]
            for of, places in grouped(list(zip(langs, folds, strict=True))).items():
                if of[0] in sent.value:
                    keys, _ = events_of([texts[i] for i in places], sent.value[of[0]])
                    held.setdefault(of, []).append(keys)
                    if sum(map(len, held[of])) >= UNIT_EVENTS:
                        yield flush(*of, np.concatenate(held.pop(of)))
        for of, keys in held.items():
            if sum(map(len, keys)):
                yield flush(*of, np.concatenate(keys))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, keys, counts in merged_rows(batches, ("lang", "shard", "salt", "fold"), np.uint32):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*of, packed(keys, True), packed(counts)), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["lang", "shard", "salt", "fold", "keys", "counts"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, folds = None, {}

        def out() -> pa.RecordBatch:
            cells = [x for f in (0, 1) for x in folds.get(f, (None, None))]
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([last[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], ["lang", "shard", "k0", "c0", "k1", "c1"])

        for (lang, shard, fold), keys, counts in merged_rows(batches, ("lang", "shard", "fold"), np.uint32):
            if last is not None and last != (lang, shard):
                yield out()
                folds = {}
            last, folds[fold] = (lang, shard), (packed(keys, True), packed(counts))
        if last is not None:
            yield out()

    rows = docs.select("lang", "fold", "text").mapInArrow(released(count), COUNTS)
    if salts > 1:
        rows = rows.repartition("lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", "fold").mapInArrow(released(merge), COUNTS)
    return rows.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "fold").mapInArrow(released(beside), "lang string, shard int, k0 binary, c0 binary, k1 binary, c1 binary")


def discounts(t: list[float]) -> np.ndarray:
    """Chen and Goodman's discounts of counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4; where these are missing, halves of the count."""
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.0
    d = [i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] else i / 2 for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))])


class Lower:
    """What a fold's model knows but the bigrams: discounts d, and by token the share g left to the lower order, the total t, and the lower order's probability p."""

    def __init__(self, stats: np.ndarray, of_counts: np.ndarray):
        total, n1, n2, n3, followed = stats.astype(np.float64)
        self.d = discounts(of_counts.tolist())
        e = discounts([float((followed == i).sum()) for i in (1, 2, 3, 4)])
        kinds = [float((followed == 1).sum()), float((followed == 2).sum()), float((followed >= 3).sum())]
        self.t = total.astype(np.float32)
        self.g = np.divide(self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3, total, out=np.ones(TOKENS), where=total > 0).astype(np.float32)
        size = followed.sum()
        rest = float(np.dot(e[1:], kinds)) / size if size else 1.0
        own = (followed - e[np.minimum(followed, 3).astype(np.int64)]) / size if size else np.zeros(TOKENS)
        self.p = (own + rest / TOKENS).astype(np.float32)

    def log(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of events with these spread keys and counts."""
        with np.errstate(over="ignore"):
            key = key * np.uint32(GATHER)
        before = key >> np.uint32(16)
        own = np.maximum(count - self.d[np.minimum(count, 3)], 0.0) / np.maximum(self.t[before], 1)
        return np.log(own + self.g[before].astype(np.float64) * self.p[key & np.uint32(0xFFFF)])


def train(model: DataFrame) -> dict[str, tuple[Lower, Lower]]:
    """By language, the lower orders of the models that score fold 0 and fold 1: each of the other fold, or of both where one is empty.

    Shards send sums by token, added up over slices of the tokens; the driver gets five numbers a token, language and fold.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = [(unpacked(r[f"k{f}"], np.uint32, True), unpacked(r[f"c{f}"], np.uint64)) for f in (0, 1) if r[f"k{f}"] is not None]
                stats, of_counts = np.zeros((3, 5, TOKENS), np.int64), np.zeros((3, 4), np.int64)
                both = [(0, parts[0]), (1, parts[-1]), (2, merged(parts))] if len(parts) == 2 else [(0 if r["k0"] is not None else 1, parts[0]), (2, parts[0])]
                for fold, (keys, counts) in both:
                    with np.errstate(over="ignore"):
                        keys = keys * np.uint32(GATHER)
                    before, token = (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64)
                    stats[fold, 0] = np.bincount(before, counts, TOKENS)
                    for i, hit in enumerate((counts == 1, counts == 2, counts >= 3), 1):
                        stats[fold, i] = np.bincount(before[hit], minlength=TOKENS)
                    stats[fold, 4] = np.bincount(token, minlength=TOKENS)
                    of_counts[fold] = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]
                rows = [(r["lang"], s, packed(np.append(stats[:, :, s * SLICE : (s + 1) * SLICE].ravel(), of_counts.ravel() if not s else []).astype(np.uint64))) for s in range(TOKENS // SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["lang", "slice", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpacked(x, np.uint64) for x in pdf["sums"])
        return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "slice": pdf["slice"].iloc[0], "sums": packed(total)}])

    schema = "lang string, slice int, sums binary"
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for lang, s, data in model.mapInArrow(released(sums), schema).groupBy("lang", "slice").applyInPandas(add, schema).collect():
        stats, of_counts = found.setdefault(lang, (np.zeros((3, 5, TOKENS), np.int64), np.zeros((3, 4), np.int64)))
        x = unpacked(data, np.uint64).astype(np.int64)
        stats[:, :, s * SLICE : (s + 1) * SLICE] = x[: 15 * SLICE].reshape(3, 5, SLICE)
        if not s:
            of_counts += x[15 * SLICE :].reshape(3, 4)
    out = {}
    for lang, (stats, of_counts) in found.items():
        crossed = stats[0, 0].any() and stats[1, 0].any()
        out[lang] = tuple(Lower(stats[f], of_counts[f]) for f in ((1, 0) if crossed else (2, 2)))
        for lower in out[lang]:
            lower.crossed = bool(crossed)
    return out


PROBES = "lang string, shard int, salt int, kind int, fold int, unit long, docs int, parts int, keys binary, places binary, times binary, directory binary"
TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
NAMES = [x.split()[0] for x in PROBES.split(", ")]


def document_scores(docs: DataFrame, used: Column, measure: Callable | None = None, fields: str = "", trained: bool = False, fit: Callable | None = None, most: int = VOCABULARY, shard_events: int = SHARD_EVENTS) -> DataFrame:
    """One row per row of `docs` (doc_id, lang, text): doc_id, lang, n_words, loss (mean negative log probability of its events; null without any), the `fields` that `measure(texts, words)` gives, and row (its `row_key`).

    The model reads the documents where `used` holds and whose text is fit by `fit(texts)`, if given; each is scored by
    the fold that it isn't in. With `trained`, rows say whether the model reads them. Every language of the training
    documents has a model of its own, LANGUAGES of them in a pass over these languages' documents. Tables that the result
    reads, and that may be forgotten once it is written, are its `_uses`.
    """
    used, lang = F.coalesce(used, F.lit(False)), F.coalesce("lang", F.lit(""))
    langs = sorted(r[0] for r in docs.filter(used).select(lang).distinct().collect())  # languages are few: each takes a model
    if len(langs) <= LANGUAGES:
        return language_scores(docs, used, measure, fields, trained, fit, most, shard_events)
    groups = [langs[i : i + LANGUAGES] for i in range(0, len(langs), LANGUAGES)]
    passes = [lang.isin(g) for g in groups] + [~lang.isin(langs)]
    parts = [language_scores(docs.filter(x), used, measure, fields, trained, fit, most, shard_events) for x in passes]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    out._uses = tuple(x for part in parts for x in part._uses)
    return out


def language_scores(docs: DataFrame, used: Column, measure: Callable | None, fields: str, trained: bool, fit: Callable | None, most: int, shard_events: int) -> DataFrame:
    """`document_scores` of documents of few languages."""
    spark = docs.sparkSession
    training = prepared(docs.filter(used))
    vocabulary, events = vocabularies(training, most, fit)
    shards, salts = max(1, min(SHARDS, math.ceil(events / shard_events))), max(1, math.ceil(events / SHARDS / SALT_EVENTS))
    sent = spark.sparkContext.broadcast(vocabulary)
    model = written(count_bigrams(training, sent, shards, salts, fit), "bigrams")
    lower = spark.sparkContext.broadcast(train(model))
    cuts = bounds(shards)
    columns = [("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), *((x.split()[0], pa.int64()) for x in fields.split(", ") if x), *[("trained", pa.int64())] * trained, ("row", pa.int64())]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(parts: list[tuple[pa.RecordBatch, dict]]) -> pa.RecordBatch:
            directory = pa.Table.from_batches([p[0] for p in parts])
            number = xxhash.xxh3_64_intdigest(directory["row"].to_numpy().tobytes()) >> 1
            salt, rows, base = number % salts, [], 0
            events: dict[tuple[str, int], list[np.ndarray]] = {}
            for rows_of, found in parts:
                for of, (places, keys, counts) in found.items():
                    events.setdefault(of, []).append(keys.astype(np.uint64) << np.uint64(16) | np.repeat(np.array(places, np.uint64) + np.uint64(base), counts))
                base += rows_of.num_rows
            for (lang, fold), keys in events.items():
                keys, times = np.unique(np.concatenate(keys), return_counts=True)
                place = (keys & np.uint64(0xFFFF)).astype(np.uint16)
                keys = (keys >> np.uint64(16)).astype(np.uint32)
                at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                rows += [(lang, s, salt, 1, fold, number, base, packed(keys[a:b], True), packed(place[a:b]), packed(times[a:b].astype(np.uint32)), None) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, directory.schema) as stream:
                stream.write_table(directory)
            rows.append(("", number % shards, salt, 1, 0, number, base, None, None, None, sink.getvalue().to_pybytes()))
            rows = [(*r[:7], len(rows), *r[7:]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

        held, size, count = [], 0, 0
        for whole in byte_slices(batches, "text", TEXT_BYTES):
            for batch in (whole.slice(i, UNIT_DOCS) for i in range(0, whole.num_rows, UNIT_DOCS)):
                raw = as_bytes(batch["text"])
                texts = [t.split() for t in raw]
                found = {}
                for of, places in grouped(list(zip(batch["lang"].to_pylist(), batch["fold"].to_pylist(), strict=True))).items():
                    keys, counts = events_of([texts[i] for i in places], sent.value.get(of[0], np.zeros(0, np.uint64)))
                    if len(keys):
                        found[of] = places, keys, counts
                more = measure(raw, texts) if measure else []
                if trained:
                    more = [*more, batch["trained"] if fit is None else pc.multiply(batch["trained"], pa.array(fit(raw)).cast(pa.int64()))]
                rows = pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], pa.array(list(map(len, texts)), pa.int64()), *more, batch["row"]], [n for n, _ in columns])
                if held and count + batch.num_rows > UNIT_DOCS:
                    yield unit(held)
                    held, size, count = [], 0, 0
                held.append((rows, found))
                size, count = size + sum(map(len, texts)), count + batch.num_rows
                if size >= UNIT_EVENTS:
                    yield unit(held)
                    held, size, count = [], 0, 0
        if held:
            yield unit(held)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.uint32), np.zeros(0, np.uint64)
        of, folds = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if of != (r["lang"], r["shard"], r["salt"]):
                    of, folds = (r["lang"], r["shard"], r["salt"]), {}
                if not r["kind"]:
                    (k0, c0), (k1, c1) = ((unpacked(r[k], np.uint32, True), unpacked(r[c], np.uint64)) if r[k] is not None else nothing for k, c in (("keys", "places"), ("times", "directory")))
                    # crossed: a fold is scored by the other one
                    folds = {0: (k1, c1), 1: (k0, c0)} if lower.value[r["lang"]][0].crossed else dict.fromkeys((0, 1), merged([(k0, c0), (k1, c1)]))
                    continue
                total = None
                if r["keys"] is not None:
                    keys, places, times = unpacked(r["keys"], np.uint32, True), unpacked(r["places"], np.uint16), unpacked(r["times"], np.uint32)
                    own, counts = folds.get(r["fold"], nothing)
                    count = np.zeros(len(keys), np.int64)
                    if len(own):
                        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                        hit = own[at] == keys
                        count[hit] = counts[at[hit]]
                    log = lower.value[r["lang"]][r["fold"]].log(keys, count) if r["lang"] in lower.value else np.full(len(keys), -math.log(TOKENS))
                    total = packed(np.bincount(places, times * log, r["docs"]).astype(np.float32).view(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((r["unit"], r["lang"], r["shard"], r["fold"], r["parts"], total, r["directory"]), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["unit", "lang", "shard", "fold", "parts", "total", "directory"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, totals, directory, parts, expected = None, None, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            if parts != expected * len(directory):
                raise RuntimeError(f"unit {unit}: {parts} parts of {expected}; the documents' order changed while a lost task ran again")
            for data in directory[:1]:
                table = pa.ipc.open_stream(data).read_all().combine_chunks()
                n = table["n_words"].to_numpy()
                sums = (totals if totals is not None else np.zeros(len(n))) / max(1, len(directory))
                loss = pa.array(-sums / np.maximum(n, 1), pa.float64(), mask=n == 0)
                for _ in directory:  # the same rows more than once, in units that don't differ
                    yield from table.append_column("loss", loss).combine_chunks().to_batches()

        for batch in batches:
            for r in batch.to_pylist():
                if r["unit"] != unit:
                    if unit is not None:
                        yield from out()
                    unit, totals, directory, parts = r["unit"], None, [], 0
                parts, expected = parts + 1, r["parts"]
                if r["directory"] is not None:
                    directory.append(r["directory"])
                else:
                    x = unpacked(r["total"], np.uint32).view(np.float32).astype(np.float64)
                    totals = x if totals is None else totals + x
        if unit is not None:
            yield from out()

    probes = prepared(docs, *[used.cast("long").alias("trained")] * trained).select("doc_id", "lang", "text", "fold", *["trained"] * trained, "row").mapInArrow(released(probe), PROBES)
    none = F.lit(None).cast
    arrays = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("lang", "shard", "salt", F.lit(0).alias("kind"), F.lit(0).alias("fold"), none("long").alias("unit"), none("int").alias("docs"), none("int").alias("parts"), F.col("k0").alias("keys"), F.col("c0").alias("places"), F.col("k1").alias("times"), F.col("c1").alias("directory"))
    by = ["lang", "shard", "salt"]
    answers = arrays.union(probes).repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(released(answer), "unit long, lang string, shard int, fold int, parts int, total binary, directory binary")
    schema = ", ".join([f"{n} {'string' if t == pa.string() else 'long'}" for n, t in columns] + ["loss double"])
    out = answers.repartition("unit").sortWithinPartitions("unit", "lang", "shard", "fold").mapInArrow(released(gather), schema)
    out = out.select("doc_id", "lang", "n_words", "loss", *[(F.col(n) == 1).alias(n) if n == "trained" else n for n, _ in columns[3:]])
    out._uses = (model,)
    return out


def quantiles(scored: DataFrame, points: dict[str, float], step: float = 0.001) -> dict[str, dict[str, float]]:
    """Per language, quantiles of `loss` to a step of `step`, and n, the number of rows, from a histogram of some thousand bins a language."""
    bins: dict[str, list] = {}
    for lang, at, n in scored.filter("loss is not null").groupBy("lang", F.floor(F.col("loss") / step).alias("bin")).agg(F.count("*")).collect():
        bins.setdefault(lang, []).append((at, n))
    out = {}
    for lang, rows in bins.items():
        at, n = np.array(sorted(rows)).T
        ends = np.cumsum(n)
        out[lang] = {name: float(at[np.searchsorted(ends, ends[-1] * q)]) * step for name, q in points.items()} | {"n": int(ends[-1])}
    return out


def with_limits(scored: DataFrame, limits: dict[str, dict[str, float]], *names: str) -> DataFrame:
    """`scored` with the named limits of each row's language, null where it has none."""
    of = lambda n: F.create_map(*[F.lit(x) for lang, v in limits.items() for x in (lang, v[n])])[F.col("lang")] if limits else F.lit(None).cast("double")
    return scored.withColumns({n: of(n) for n in names})
