"""Connected components of a link table by alternating large and small stars, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (a, b longs): the smallest node that links reach.

    Each round moves every node's neighbours to its smallest neighbour, first the larger ones, then the smaller ones, so
    the rounds grow as the logarithm of the longest chain. Rounds are written to the shared folder, and end when the
    table stays as it was. Loops, repeated links and links with a null end do no harm.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    found = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    found = written(found, name)
    seen = state(found)
    while True:
        both = found.union(found.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        found, before = written(small, name), found
        forget(before)
        now = state(found)
        if now == seen:
            break
        seen = now
    roots = found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
