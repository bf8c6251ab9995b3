"""N-gram Jaccard join: parity sketches of shingle sets, joined by pigeonhole in size bands, then verified.

Two sets with a Jaccard similarity of at least t differ in at most d = (n1 + n2)(1 - t)/(1 + t) shingles. Within a band of
sizes d is bounded by some k, so of k + 1 pieces into which a hash deals the shingles, one at least is free of
differences. A piece's key is the XOR of its shingles' hashes; equal keys make candidates. A piece's bit sketch is the
parity of 32 counters; the Hamming distance of two sketches is never over the number of differing shingles, so it
discards candidates without loss. What is left is compared shingle by shingle.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, forget, released, small_side, written
from .components import connected_components

#: Sizes of a band grow by this factor.
RATIO = 1.4
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 1024
MEMO_WORDS = 150_000
#: Bytes of text whose shingles a task holds at a time.
STEP_BYTES = 2 << 20
#: Ids that are broadcast at most to pick the texts of candidates (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of the words met of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(words: list[bytes], width: int, known: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of the whole sequence if it is shorter."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    run = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - run + 1, run * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for j in range(run):
            out = mix(out ^ h[j : j + len(out)]) if j else out + h[: len(out)] * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mix(out))


def band_edges(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Least sizes of the bands. Smaller sets than the first link only with equal sets."""
    first = 1
    while (2 * first + 1) * (100 - percent) < 100 + percent:
        first += 1
    edges = [first]
    while edges[-1] < most:
        edges.append(max(edges[-1] * 100 // percent + 2, int(edges[-1] * RATIO)))
    return np.array(edges, np.int64)


@functools.cache
def pieces_of(least: int, most: int, percent: int) -> tuple[int, int]:
    """Pieces of a band of sizes from `least` to `most`, and how many of them linked sets agree on besides one.

    Sets agree on one piece for each piece over the number of differences. So many more are made that nearly all
    sets have no more empty pieces than that; a set like that leaves its empty pieces out, which lose no link then.
    """
    need = int(2 * most * (100 - percent) // (100 + percent)) + 1

    def over(spare: int) -> float:
        mean = (need + spare) * math.exp(-least / (need + spare))
        return 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(spare + 1))

    found = {x: over(x) for x in range(need // 2 + 2)} if need < 4000 else {need // 8: 0.0}
    spare = next((x for x, p in found.items() if p < 1e-4), min(found, key=found.get))
    return need + spare, spare


def sketch(hashes: np.ndarray, band: int, pieces: int, spare: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Piece keys and parity words of a sorted set, and how many keys it may do without: `spare`, less the empty pieces.
    Keys of empty pieces are there only if there are more of these than `spare`.
    """
    piece = ((hashes >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    counts = np.bincount(piece.astype(np.int64), minlength=pieces)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    keys, bits = np.zeros(pieces, np.uint64), np.zeros(pieces, np.uint32)
    keys[full] = np.bitwise_xor.reduceat(hashes, starts)
    bits[full] = np.bitwise_xor.reduceat(np.uint32(1) << (hashes & np.uint64(31)).astype(np.uint32), starts)
    with np.errstate(over="ignore"):
        keys = mix(keys ^ (np.arange(pieces, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
    empty = pieces - len(full)
    return (keys[full], bits, spare - empty) if empty <= spare else (keys, bits, spare)


def bands_of(n: int, edges: np.ndarray, percent: int) -> list[int]:
    """The band of a set of `n` elements and, near its upper end, the next; none of very small sets."""
    band = int(np.searchsorted(edges, n, "right")) - 1
    return [] if band < 0 else [band, band + 1] if n * 100 // percent >= edges[band + 1] else [band]


def heads(docs: DataFrame, width: int) -> DataFrame:
    """Of every row of `docs` (doc_id, text): doc_id, a hash h of the text, the set's size n, and the set's two keys k1 and k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in byte_slices(batches, "text", STEP_BYTES):
            sets = [shingle_set(t.lower().split(), width, known) for t in as_bytes(batch["text"])]
            k1 = [int(np.add.reduce(s).astype(np.int64)) if len(s) else 0 for s in sets]
            k2 = [int(np.bitwise_xor.reduce(mix(~s)).astype(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], *(pa.array(x, pa.int64()) for x in (list(map(len, sets)), k1, k2))], ["doc_id", "h", "n", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(released(run), "doc_id long, h long, n long, k1 long, k2 long")


def piece_keys(nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, node, band): a row per piece of every row of `nodes` (node, text), in each of its bands."""
    edges = band_edges(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in byte_slices(batches, "text", STEP_BYTES):
            found = [(node, b, sketch(s, b, *pieces_of(int(edges[b]), int(edges[b + 1]) - 1, percent))[0]) for node, text in zip(batch["node"].to_pylist(), as_bytes(batch["text"]), strict=True) for s in [shingle_set(text.lower().split(), width, known)] for b in bands_of(len(s), edges, percent)]
            if found:
                sizes = [len(k) for _, _, k in found]
                cols = np.concatenate([k for _, _, k in found]).view(np.int64), np.repeat(np.array([x for x, _, _ in found], np.int64), sizes), np.repeat(np.array([x for _, x, _ in found], np.int32), sizes)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["key", "node", "band"])

    return nodes.select("node", "text").mapInArrow(released(run), "key long, node long, band int")


def sketches(nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, band, n, slack, bits) of every row of `nodes` (node, text), in each of its bands: size, keys it may do without, parity words."""
    edges = band_edges(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in byte_slices(batches, "text", STEP_BYTES):
            rows = []
            for node, text in zip(batch["node"].to_pylist(), as_bytes(batch["text"]), strict=True):
                s = shingle_set(text.lower().split(), width, known)
                for b in bands_of(len(s), edges, percent):
                    _, bits, slack = sketch(s, b, *pieces_of(int(edges[b]), int(edges[b + 1]) - 1, percent))
                    rows.append((node, b, len(s), slack, bits.tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["node", "band", "n", "slack", "bits"])

    return nodes.select("node", "text").mapInArrow(released(run), "node long, band int, n long, slack int, bits binary")


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (key, node, band) sorted by key and node -> (key, band, node, lo) of all but the first node, lo, of each key."""
    last_key, last_node, lo = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch["key"].to_numpy(), batch["node"].to_numpy()
        start = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        run = np.cumsum(start)
        first = np.concatenate([[lo if lo is not None else 0], node[start]])[run]
        repeated = ~start & np.concatenate([[last_node is not None and node[0] == last_node], node[1:] == node[:-1]])
        at = np.flatnonzero((node != first) & ~repeated)
        last_key, last_node, lo = key[-1], node[-1], first[-1]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), batch["band"].take(pa.array(at)), pa.array(node[at]), pa.array(first[at])], ["key", "band", "node", "lo"])


def within(n1: np.ndarray, n2: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many elements are similar enough."""
    return (n1 + n2) * (100 - percent) >= apart * (100 + percent)


def near_by_sketch(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of `pairs` (a, b, band), those whose sketches are near enough: distinct (a, b)."""
    sides = pairs
    for x in ("a", "b"):
        sides = sides.join(nodes.select(F.col("node").alias(x), "band", F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")), [x, "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "bitsa"):
            apart = np.array([int(np.bitwise_count(np.frombuffer(x, np.uint32) ^ np.frombuffer(y, np.uint32)).sum()) for x, y in zip(batch["bitsa"].to_pylist(), batch["bitsb"].to_pylist(), strict=True)], np.int64)
            near = within(batch["na"].to_numpy(), batch["nb"].to_numpy(), apart, percent)
            yield pa.RecordBatch.from_arrays([batch[x].filter(pa.array(near)) for x in ("a", "b")], ["a", "b"])

    return sides.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(released(run), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of `pairs` (a, b), those whose texts are similar enough, compared shingle by shingle."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in byte_slices(batches, "text", STEP_BYTES):
            found = [shingle_set(t.lower().split(), width, known).tobytes() for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], ["doc_id", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "x"):
            linked = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                linked.append(bool(len(x) and len(y) and within(len(x), len(y), len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)), percent)))
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(linked, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(small_side(ids, BROADCAST_IDS), "doc_id", "left_semi")
    table = written(texts.mapInArrow(released(sets), "doc_id long, hashes binary"), "sets")
    sides = pairs.join(table.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a").join(table.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    out = written(sides.select("a", "b", "x", "y").mapInArrow(released(compare), "a long, b long").distinct(), "links")
    forget(ids, table)
    return out


def block_pairs(percent: int, best: bool):
    """Task: rows sorted by (key, i, j) -> pairs (a, b) near by sketch of block i's with block j's nodes of other components."""

    def group(block: np.ndarray, i: int, j: int, node: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list) -> tuple:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        words = np.frombuffer(b"".join(bits), np.uint32).reshape(len(bits), -1)
        a, b = [], []
        step = max(1, 500_000 // max(1, len(right) * words.shape[1]))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            apart = np.bitwise_count(words[own][:, None] ^ words[right][None]).sum(2, dtype=np.int64)
            apart = np.maximum(apart, abs(n[own][:, None] - n[right][None]))
            near = (comp[own][:, None] != comp[right][None]) & within(n[own][:, None], n[right][None], apart, percent)
            for k in np.flatnonzero(near.any(1)):
                to = np.flatnonzero(near[k])
                if best:
                    to = to[np.argsort(apart[k, to], kind="stable")]
                    to = to[np.unique(comp[right[to]], return_index=True)[1]]
                a.append(np.full(len(to), node[own[k]]))
                b.append(node[right[to]])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "i", "j", "block", "node", "component", "n")
        held = [*(np.zeros(0, np.int64) for _ in names), np.zeros(0, object)]

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, i, j, block, node, comp, n, bits = cols
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if e - s > 1:
                    x, y = group(block[s:e], int(i[s]), int(j[s]), node[s:e], comp[s:e], n[s:e], bits[s:e].tolist())
                    a += x
                    b += y
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.empty(batch.num_rows, object)
            bits[:] = batch["bits"].to_pylist()
            held = [np.concatenate(x) for x in zip(held, [*(batch[x].to_numpy() for x in names), bits], strict=True)]
            cut = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))[-1] + 1) if (held[0][0], held[1][0], held[2][0]) != (held[0][-1], held[1][-1], held[2][-1]) else 0
            if cut:  # the last group's rows may go on
                yield work([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield work(held)

    return run


def needed(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """`members` (key, band, node, component) of buckets with two components or more, but for the `slack` fullest buckets of each node and band.

    Linked sets share more pieces than any of them has slack, counting pieces that are empty in both. All nodes rank
    buckets alike, so the emptiest bucket that two of them share is among those that both keep.
    """
    of = members.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("l"), F.max("component").alias("h"))
    rows = members.join(written(of.filter("size > 1"), "sizes"), "key").join(nodes.select("node", "band", "slack"), ["node", "band"])
    rank = W.partitionBy("node", "band").orderBy(F.desc("size"), "key")
    return rows.withColumn("r", F.row_number().over(rank)).filter("r > slack and l < h").select("key", "band", "node", "component")


def cross_pairs(members: DataFrame, nodes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) near by sketch of nodes in one bucket and different components, compared in blocks of nodes.

    `members` (key, band, node, component). With `best`, of a node's pairs with a component only the nearest.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("component").alias("l"), F.max("component").alias("h")).filter("l < h").select("key", "blocks")
    dealt = members.join(written(blocks, "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(nodes.select("node", "band", "n", "bits"), ["node", "band"])
    dealt = dealt.withColumn("at", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(block, x) as i, greatest(block, x) as j))"))).select("key", "at.i", "at.j", "block", "node", "component", "n", "bits")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(released(block_pairs(percent, best)), "a long, b long").distinct()


def jaccard_links(docs: DataFrame, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n) of every row, links (a, b) that connect the same documents as all links do).

    Exact copies are one node each. One shuffle of the nodes' piece keys leaves those that two nodes share. Every node of
    a bucket is compared with the bucket's smallest node, which costs no more rows than the bucket has; then pairs in
    different components only, until none is left untested.
    """
    table = written(heads(docs, width), "heads")
    sized = table.filter("n > 0 and doc_id is not null")
    groups = written(sized.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "groups")
    copies = written(sized.join(groups, ["n", "k1", "k2"]).filter("doc_id <> node").select("doc_id", "h", "node").distinct(), "copies")
    forget(groups)
    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text", F.xxhash64("text").alias("h")).filter("node is not null")
    own = own.join(small_side(copies.select(F.col("doc_id").alias("node"), "h"), BROADCAST_IDS), ["node", "h"], "left_anti")
    pieces = piece_keys(own, width, percent).repartition("key").sortWithinPartitions("key", "node")
    shared = written(pieces.mapInArrow(released(shared_keys), "key long, band int, node long, lo long"), "buckets")
    ids = written(shared.select(F.explode(F.array("lo", "node")).alias("node")).distinct(), "ids")
    nodes = written(sketches(own.join(small_side(ids, BROADCAST_IDS), "node", "left_semi"), width, percent), "nodes")
    stars = shared.select("band", F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    tested = written(near_by_sketch(stars, nodes, percent), "stars")
    links = verified(tested, docs, width, percent)
    for best in (True, False):
        members = shared.select("key", "band", "node").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        members = written(needed(members, nodes), "members")
        pairs = written(cross_pairs(members, nodes, percent, best).join(tested, ["a", "b"], "left_anti"), "pairs")
        forget(members)
        if not pairs.isEmpty():
            links = written(links.union(verified(pairs, docs, width, percent)), "links")
            tested = written(tested.union(pairs), "tested")
    forget(shared, ids, nodes)
    return table, links.union(copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs without ASCII blanks, A-Z in lower case; sets hold distinct runs of `width` words, or the whole
    sequence of a shorter text. Documents link when 100 * intersection >= `percent` * union.

    Null or empty text, or blanks only: empty set, linked with nothing. Null doc_id: sized, never linked, null component.
    Rows with the same doc_id are one node that links by any of its texts. Columns besides doc_id and text are ignored.
    Empty tables give an empty result. Shingles are known by 64-bit hashes.
    """
    table, links = jaccard_links(docs, width, percent)
    found = connected_components(links)
    rows = table.select("doc_id", F.col("n").alias("n_shingles"))
    return rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
