"""Source divergence audit: how far each source's use of terms is from its language and from the language's other sources.

Every pair of sources starts from its baseline, V times the value of two zero counts. An inverted index holds a posting for
each source that uses a term, and only postings emit corrections: those of one source alone depend on its count and the
other source's zero, so they are emitted once for each distinct count; those of two sources that both use a term come from
the term's postings. Terms are ranked by windows, first within slices of a source, then over what is left of these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, small_side, written

#: Distinct terms that a task counts before it sends them on, and bytes of a text that are split at a time.
HELD, STEP = 400_000, 4 << 20
#: Groups (language, source) that are broadcast at most; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Slices of a source's terms that are ranked by themselves.
SLICES = 16
#: Letters and all bytes beyond ASCII stay, A-Z in lower case; the rest parts terms.
LETTERS = bytes(x if x >= 128 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some STEP bytes at a time."""
    data, at = data.translate(LETTERS), 0
    while len(data) - at > STEP:
        cut = data.find(b" ", at + STEP)
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut
    yield (data[at:] if at else data).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (lang, source, text) -> (lang, source, term, n, docs), counted over the task's rows as far as HELD terms go."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            k = len(count)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in byte_slices(batches, "text"):
        for lang, source, data in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), as_bytes(batch["text"]), strict=True):
            count, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(data):
                count.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(count) for count, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 (count + 1) / total), exact for any counts: in longs as far as they go, in decimals beyond."""
    one = count + F.lit(1).cast("long")
    wide = F.call_function("div", one.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.when(count < 9_000_000_000, F.call_function("div", one * F.lit(1_000_000_000).cast("long"), total)).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q), in longs: shares are 10**9 + 1 at most."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs` (text, lang, source): part 'pair' compares a source with each other
    one of its language, part 'term' has the `most_terms` terms that it uses most above its language's share.

    A language keeps the terms found in at least `least_docs` of its rows; a row is a document, whatever its other columns
    hold. Null text, lang and source are ''. A group without terms, or of a language that keeps none, still has its pairs
    (value 0 where nothing is kept). Ties are ranked by the items' bytes. Repeated rows count each. Other columns are
    ignored. Empty tables give an empty result.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    # Tasks have combined their rows, so one exchange by term serves both aggregations.
    counted = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = counted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("postings"), F.sum("docs").alias("docs"))
    index = written(index.filter(F.col("docs") >= least_docs).select("lang", "term", "postings"), "postings")

    flat = index.select("lang", "term", F.expr("aggregate(postings, 0L, (s, x) -> s + x.n)").alias("lang_n"), F.inline("postings"))
    kept = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.expr("aggregate(postings, 0L, (s, x) -> s + x.n)")).alias("lang_total"))
    used = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(kept, "lang", "left").join(used, ["lang", "source"], "left")
    none = F.lit(0).cast("long")
    v = F.coalesce("v", none)
    groups = groups.select("lang", "source", v.alias("v"), F.greatest(F.coalesce("total", none) + v, F.lit(1)).alias("m"), F.greatest(F.coalesce("lang_total", none) + v, F.lit(1)).alias("lang_m"))
    groups = written(groups.withColumn("zero", share(none, F.col("m"))), "groups")
    near = small_side(groups, BROADCAST_GROUPS)

    # term: each posting's share against the language's
    shared = flat.join(near, ["lang", "source"]).select("lang", "source", "term", "n", "zero", share(F.col("n"), F.col("m")).alias("p"), share(F.col("lang_n"), F.col("lang_m")).alias("q"))
    value = shared.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = (F.desc("value"), F.asc("item"))
    sliced = value.withColumn("_slice", F.pmod(F.xxhash64("item"), F.lit(SLICES)))
    sliced = sliced.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "source", "_slice").orderBy(*order))).filter(F.col("_rank") <= most_terms)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)))
    by_term = ranked(sliced.drop("_slice", "_rank")).filter(F.col("rank") <= most_terms)

    # pair: baseline, corrections of one source's postings, corrections of both's
    a = groups.select("lang", F.col("source").alias("a"), "v", F.col("m").alias("ma"), F.col("zero").alias("za"))
    b = near.select("lang", F.col("source").alias("b"), F.col("m").alias("mb"), F.col("zero").alias("zb"))
    exact = lambda x: x.cast("decimal(38,0)").alias("value")
    flat_zero = distance(F.col("za"), F.col("zb"))
    baseline = a.join(b, "lang").filter("a <> b").select("lang", "a", "b", exact(F.when(F.col("v") > 0, flat_zero).otherwise(none).cast("decimal(20,0)") * F.col("v")))
    uses = written(shared.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.first("p").alias("p"), F.first("zero").alias("za")), "uses").withColumnRenamed("source", "a")
    alone = uses.join(b, "lang").filter("a <> b")
    times = lambda x: exact(x.cast("decimal(20,0)") * F.col("terms"))
    first = alone.select("lang", "a", "b", times(distance(F.col("p"), F.col("zb")) - flat_zero))
    second = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), times(distance(F.col("zb"), F.col("p")) - distance(F.col("zb"), F.col("za"))))
    both = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("postings")).filter(F.size("postings") > 1)
    both = both.select("lang", "postings", F.explode("postings").alias("x")).select("lang", "x", F.explode("postings").alias("y")).filter("x.source <> y.source")
    px, zx, py, zy = (F.col(c) for c in ("x.p", "x.zero", "y.p", "y.zero"))
    both = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), exact(distance(px, py) - distance(px, zy) - distance(zx, py) + distance(zx, zy)))
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = baseline.union(first).union(second).union(both.select("lang", "a", "b", exact(F.col("value")))).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").cast("long").alias("value"))
    columns = ["lang", "source", "item", "value", "rank"]
    out = ranked(pairs).select(F.lit("pair").alias("part"), *columns).union(by_term.select(F.lit("term").alias("part"), *columns))
    return out.select("lang", "source", "part", "item", "value", "rank")
