"""Incremental ingestion: what has changed, what goes, what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that global numbering sorts by.
RANGES = 64


def numbered(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """`df` with its rank (from 1) by a number column, without bringing all rows to one task: rows are ranked within ranges
    of the column, and the ranges' counts (RANGES rows at most) are added up.
    """
    cuts = df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    at = F.lit(0)
    for c in sorted(set(cuts)):
        at = at + (F.col(order) > F.lit(c)).cast("int")
    rows = df.withColumn("_range", at)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.alias("x").join(F.broadcast(counts.alias("y")), F.col("y._range") < F.col("x._range"), "left").groupBy(F.col("x._range").alias("_range")).agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_range").orderBy(order)))
    return ranked.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


def with_status(files: DataFrame, manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """`files` (book_id, hash, ...) with status: new, changed, missing_index or current, by `manifest` (book_id, hash) and `artifacts` (book_id)."""
    old = manifest.select("book_id", F.col("hash").alias("old_hash"))
    made = artifacts.select("book_id", F.lit(True).alias("made")).distinct()
    rows = files.join(old, "book_id", "left").join(made, "book_id", "left")
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "changed").when(F.col("made").isNull(), "missing_index").otherwise("current")
    return rows.select(*files.columns, status.alias("status"))


def plan_changes(files: DataFrame, manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(book_id, status) of each of `files`, as `with_status` says."""
    return with_status(files.select("book_id", "hash"), manifest, artifacts).select("book_id", "status")


def merge_manifest(manifest: DataFrame, processed: DataFrame, files: DataFrame) -> DataFrame:
    """Next manifest: rows whose file still exists, replaced or joined by `processed`; later ones win."""
    kept = manifest.join(files.select("book_id").distinct(), "book_id", "left_semi")
    rest = [c for c in manifest.columns if c != "book_id"]
    old, new = kept.select("book_id", F.struct(*rest).alias("o")), processed.select("book_id", F.struct(*rest).alias("n"))
    return old.join(new, "book_id", "full_outer").select("book_id", *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def removed_books(manifest: DataFrame, following: DataFrame) -> DataFrame:
    """Rows of `manifest` that the following one lacks."""
    return manifest.join(following, "book_id", "left_anti")


def obsolete_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assets (book_id, asset) of the old manifest that the new one (both with arrays `assets`) doesn't name."""
    spread = lambda df: df.select("book_id", F.explode("assets").alias("asset"))
    return spread(old).join(spread(new), ["book_id", "asset"], "left_anti")


def batches(pending: DataFrame, size: int = 50, order: str = "pos") -> DataFrame:
    """`pending` with its batch (from 1) by `order`."""
    return numbered(pending, order, "_at").withColumn("batch", F.ceil(F.col("_at") / size).cast("long")).drop("_at")


def duplicate_ids(files: DataFrame) -> DataFrame:
    """(book_id, n, last_pos) of ids that several of `files` (book_id, pos) have; the last file wins."""
    return files.groupBy("book_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos")).filter("n > 1")


def without_books(manifest: DataFrame, books: DataFrame) -> DataFrame:
    """`manifest` but for the given books (book_id), such as those whose chapters are all fallback ones."""
    return manifest.join(books.select("book_id").distinct(), "book_id", "left_anti")

