"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours, its close links kept.

The graph starts from sign bands of random projections: rows that share a band's bits stand side by side in a range
partitioning and become neighbours. Each round joins every list with its members' vectors and offers each member the
nearest others of the list. Pairs within the threshold are links from when they are seen, whatever becomes of the lists.
Close neighbours of a node's own component can't crowd out the rest: a list has as many places for nodes of other
components, and offers those too. The links inside a component are all found at the end, compared in blocks. An audit
compares a share of the nodes with all; while it finds too little, another start and round follow, then an exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_side, written
from .components import connected_components

#: Neighbours of a node's list, bands of a start, and rows of a band that a row is linked to.
LIST, BANDS, NEXT = 10, 12, 4
#: Nodes that one task compares with as many others when lists are enlarged.
BLOCK = 1024
#: Share of the nodes that the audit compares with all; about twice LEAST at least of each class of component sizes.
SHARE, LEAST = 0.01, 64
#: Nodes that are broadcast at a time, to be compared with all, and components with repeated ids that are broadcast at most.
SLICE, BROADCAST_NAMES = 4096, 100_000


def unit(vectors: list) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_batch(a: list, b: list, sim: list) -> pa.RecordBatch:
    cols = [np.concatenate(x) if x else np.zeros(0) for x in (a, b, sim)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], ["a", "b", "sim"])


def start(nodes: DataFrame, dim: int, count: int, seed: int) -> DataFrame:
    """Links (a, b, sim) between rows that stand near each other in a band."""
    bits = min(24, max(2, math.ceil(math.log2(max(2, count / 8)))))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dim, BANDS * bits + BANDS))
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                x = unit(part["vector"].to_pylist()) @ planes
                for band in range(BANDS):
                    code = (x[:, band * bits : (band + 1) * bits] > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), band, np.int32)), pa.array(code.astype(np.int64)), pa.array(x[:, BANDS * bits + band]), part["node"], part["vector"]], ["band", "code", "along", "node", "vector"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            code = batch["band"].to_numpy().astype(np.int64) << 32 | batch["code"].to_numpy()
            node, x = batch["node"].to_numpy(), unit(batch["vector"].to_pylist()) if batch.num_rows else np.zeros((0, dim))
            if last is not None:
                code, node, x = (np.concatenate([p, q]) for p, q in zip(last, (code, node, x), strict=True))
            a, b, sim = [], [], []
            for d in range(1, NEXT + 1):
                at = np.flatnonzero(code[:-d] == code[d:])
                a.append(node[at])
                b.append(node[at + d])
                sim.append((x[at] * x[at + d]).sum(1))
            last = code[-NEXT:], node[-NEXT:], x[-NEXT:]
            yield pairs_batch(a, b, sim)

    rows = nodes.select("node", "vector").mapInArrow(bands, f"band int, code long, along double, node long, vector {dict(nodes.dtypes)['vector']}")
    return rows.repartitionByRange("band", "code", "along", "node").sortWithinPartitions("band", "code", "along", "node").mapInArrow(link, "a long, b long, sim double").filter("a <> b")


def lists_of(links: DataFrame, found: DataFrame) -> DataFrame:
    """Each node's LIST nearest neighbours of its own component and LIST of others (a, b, sim), among links in either direction."""
    both = links.union(links.select("b", "a", "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    both = both.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    both = both.select("a", "b", "sim", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("own"))
    return both.withColumn("r", F.row_number().over(W.partitionBy("a", "own").orderBy(F.desc("sim"), "b"))).filter(F.col("r") <= LIST).select("a", "b", "sim")


def local_join(lists: DataFrame, nodes: DataFrame, dim: int, threshold: float, most: int = 3) -> DataFrame:
    """Links between members of a list: each member's `most` nearest others, `most` nearest of other components, and all of other components within the threshold. `nodes` have a component."""
    members = lists.select(F.col("a").alias("owner"), F.col("b").alias("node")).union(lists.select(F.col("a").alias("owner"), F.col("a").alias("node")).distinct())
    rows = members.join(nodes.select("node", "vector", "component"), "node").repartition("owner").sortWithinPartitions("owner", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def work(owner: np.ndarray, node: np.ndarray, component: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            a, b, sim = [], [], []
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s < 2:
                    continue
                m = x[s:e] @ x[s:e].T
                np.fill_diagonal(m, -2)
                k = min(most, e - s - 1)
                other = np.where(component[s:e, None] == component[None, s:e], -2, m)
                near = other >= threshold
                for of in (m, other):
                    np.put_along_axis(near, np.argpartition(-of, k - 1, axis=1)[:, :k], True, axis=1)
                i, j = np.nonzero(near & (m > -2))
                a.append(node[s:e][i])
                b.append(node[s:e][j])
                sim.append(m[i, j])
            return pairs_batch(a, b, sim)

        for batch in batches:
            part = batch["owner"].to_numpy(), batch["node"].to_numpy(), batch["component"].to_numpy(), unit(batch["vector"].to_pylist()) if batch.num_rows else np.zeros((0, dim))
            held = [np.concatenate([p, q]) for p, q in zip(held, part, strict=True)] if held else list(part)
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last owner's rows may go on
            if cut:
                yield work(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if held and len(held[0]):
            yield work(*held)

    return rows.select("owner", "node", "component", "vector").mapInArrow(join, "a long, b long, sim double")


def enlarged(nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(node, links): of each node of `found` (node, component), the vectors linked with it in its component, compared in blocks."""
    blocks = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = found.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(nodes, "node")
    rows = rows.withColumn("at", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(block, x) as i, greatest(block, x) as j))"))).select("component", "at.i", "at.j", "block", "node", "copies", "vector")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["block"] == pdf[x].iloc[0]] for x in ("i", "j"))
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": []})
        near = unit(left["vector"].tolist()) @ unit(right["vector"].tolist()).T >= threshold
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": left["node"].to_numpy(), "links": near @ right["copies"].to_numpy()})
        return pd.DataFrame({"node": np.concatenate([left["node"], right["node"]]), "links": np.concatenate([near @ right["copies"].to_numpy(), near.T @ left["copies"].to_numpy()])})

    return rows.groupBy("component", "i", "j").applyInPandas(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def slices(nodes: DataFrame, chosen: DataFrame) -> Iterator:
    """Broadcasts of the nodes, components, classes and vectors of `chosen`, SLICE at a time; each is let go after use."""
    spark = nodes.sparkSession
    count = chosen.count()
    parts = max(1, math.ceil(count / SLICE))
    dealt = written(chosen.select("node", "component", "class", "vector", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(parts)).cast("int").alias("part")), "slices")
    for i in range(parts if count else 0):
        rows = dealt.filter(F.col("part") == i).select("node", "component", "class", "vector").toArrow()
        if rows.num_rows:
            sent = spark.sparkContext.broadcast((*(rows[c].to_numpy() for c in ("node", "component", "class")), unit(rows["vector"].to_pylist())))
            yield sent
            sent.destroy()


def placed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """`nodes` with their component (their own where they have no link) and its class, the whole part of the binary logarithm of its size."""
    sizes = found.groupBy("component").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("class"))
    rows = nodes.select("node", "vector").join(found.join(sizes, "component"), "node", "left")
    return rows.select("node", "vector", F.coalesce("component", "node").alias("component"), F.coalesce("class", F.lit(0)).alias("class"))


def audit(nodes: DataFrame, threshold: float) -> float:
    """Least recall by class of component sizes: of SHARE of the class's `nodes` (placed), about twice LEAST at least, the links within components over those with all nodes."""
    sizes = {r[0]: r[1] for r in nodes.groupBy("class").count().collect()}
    taken = [(c, min(1.0, max(SHARE, 2 * LEAST / n))) for c, n in sizes.items()]
    share = F.create_map(*[F.lit(x) for t in taken for x in t])[F.col("class")] if taken else F.lit(1.0)
    chosen = nodes.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    true: dict[int, list[int]] = {}
    for sent in slices(nodes, chosen):

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, own, kind, x = sent.value
            for batch in batches:
                for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                    i, j = np.nonzero(x @ unit(part["vector"].to_pylist()).T >= threshold)
                    differ = ids[i] != part["node"].to_numpy()[j]
                    i, j = i[differ], j[differ]
                    got = own[i] == part["component"].to_numpy()[j]
                    kinds = np.unique(kind[i])
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(np.array([(kind[i] == c).sum() for c in kinds], np.int64)), pa.array(np.array([got[kind[i] == c].sum() for c in kinds], np.int64))], ["class", "n", "got"])

        for c, n, got in nodes.select("node", "component", "vector").mapInArrow(near, "class int, n long, got long").groupBy("class").agg(F.sum("n"), F.sum("got")).collect():
            at = true.setdefault(c, [0, 0])
            at[0] += n
            at[1] += got
    return min((got / n for n, got in true.values()), default=1.0)


def exact(nodes: DataFrame, threshold: float) -> DataFrame:
    """All links (a, b, sim) between `nodes` (placed) of different components, slice by slice."""
    out = None
    for sent in slices(nodes, nodes):

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, own, _, x = sent.value
            for batch in batches:
                for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                    m = x @ unit(part["vector"].to_pylist()).T
                    i, j = np.nonzero((m >= threshold) & (own[:, None] < part["component"].to_numpy()[None, :]))
                    yield pairs_batch([ids[i]], [part["node"].to_numpy()[j]], [m[i, j]])

        links = written(nodes.select("node", "component", "vector").mapInArrow(near, "a long, b long, sim double"), "exact")
        out = links if out is None else out.union(links)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, rounds: int = 2, most_rounds: int = 6, recall: float = 0.98) -> DataFrame:
    """One row per distinct row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows with the same id and different vectors are vectors of their own, each with its links and its component.

    Equal vectors are one node with a number of copies. After `rounds` rounds the audit decides whether up to
    `most_rounds` follow; if it still finds less than `recall`, all nodes are compared. No link is below the threshold;
    the links of a component are all found.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors of different
    lengths don't link. Null vec_id: no component, null kept. Other columns are ignored. Empty tables give an empty result.
    """
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # no number loses digits
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("vector")).distinct()
    fine = "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vector, x -> x <> 0)"
    valid = rows.filter(fine)
    # A vector is named by its smallest id; where another vector has that name, by a number beyond all ids.
    named = valid.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    named = written(named.withColumn("again", F.row_number().over(W.partitionBy("first").orderBy("vector"))).withColumn("number", F.monotonically_increasing_id()), "named")
    beyond = (named.agg(F.max("first")).first()[0] or 0) + 1
    nodes = named.select("vector", "copies", "first", F.size("vector").alias("dim"), F.when(F.col("again") == 1, F.col("first")).otherwise(F.col("number") + F.lit(beyond)).alias("node"))
    results = []
    for dim, count in sorted(nodes.groupBy("dim").count().collect()):
        own = nodes.filter(F.col("dim") == dim)
        lists, links, found, done = None, None, None, 0

        def linked(pairs: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            """All links so far with those of `pairs`, and their components."""
            more = pairs.filter(F.col("sim") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
            links = written((more if links is None else links.union(more)).groupBy("a", "b").agg(F.max("sim").alias("sim")), "links")
            return links, written(connected_components(links), "found")

        while True:
            pairs = written(start(own, dim, count, seed=done), "pairs")
            steps = rounds if not done else 1
            for step in range(steps + 1):
                links, found = linked(pairs, links)
                lists = written(lists_of(pairs if lists is None else pairs.union(lists), found), "lists")
                if step < steps:
                    pairs = written(local_join(lists, placed(own, found), dim, threshold), "pairs")
            done += max(steps, 1)
            now = written(placed(own, found), "placed")
            if audit(now, threshold) >= recall:
                break
            if done >= most_rounds:
                links, found = linked(exact(now, threshold), links)
                break
        results.append(own.select("node", "vector", "copies", "first").join(enlarged(own, found, threshold), "node", "left").join(found, "node", "left").select("node", "vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = rows.select("vec_id", "vector")
    if not results:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    every = results[0]
    for r in results[1:]:
        every = every.union(r)
    # A component's smallest node is its smallest id, unless one of the other names stands for a smaller one.
    other = every.filter(F.col("node") >= beyond).groupBy(F.col("component_id").alias("_of")).agg(F.min("first").alias("_first"))
    every = every.join(small_side(written(other, "other-names"), BROADCAST_NAMES), F.col("component_id") == F.col("_of"), "left").withColumn("component_id", F.least("component_id", "_first"))
    linked = valid.join(every, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.filter(f"not coalesce({fine}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
