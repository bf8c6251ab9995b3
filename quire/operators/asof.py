"""As-of joins of places with the next start at or after them, however many a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_starts(targets: DataFrame, starts: DataFrame, key: str, at: str, folder: str) -> DataFrame:
    """`targets` (key, at, ...) with next, the least `at` of `starts` (key, at) of the same key that isn't less; null if there is none.

    Both are sorted together in ranges of (key, at), which are written to `folder` so that they stay as they are; within a
    range the next start is carried back row by row, and across the ends of ranges by a table of one row for each key and
    range. So a key's rows are spread over many tasks. Targets with a null key or place have no next start.
    """
    rest = [c for c in targets.columns if c not in (key, at)]
    a = targets.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.lit(0).alias("_"), *rest).alias("_row"))
    b = starts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind")).filter("_key is not null and _at is not null").distinct()
    ranged = a.unionByName(b, allowMissingColumns=True).repartitionByRange("_key", "_at", "_kind").withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(folder)
    ranged = targets.sparkSession.read.schema(ranged.schema).parquet(folder)
    start = F.when(F.col("_kind") == 1, F.col("_at"))
    back = W.orderBy(F.desc("_range")).partitionBy("_key").rowsBetween(W.unboundedPreceding, -1)
    carried = ranged.groupBy("_key", "_range").agg(F.min(start).alias("_first")).withColumn("_carried", F.last("_first", ignorenulls=True).over(back)).drop("_first")
    own = W.partitionBy("_key", "_range").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranged.withColumn("_own", F.last(start, ignorenulls=True).over(own)).filter("_kind = 0")
    rows = rows.join(carried.withColumnRenamed("_key", "_k").withColumnRenamed("_range", "_r"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    found = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_own", "_carried"))
    return rows.select(F.col("_key").alias(key), F.col("_at").alias(at), *[F.col(f"_row.{c}").alias(c) for c in rest], found.alias("next"))
