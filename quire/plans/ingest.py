"""Ingestion: archives to decoded books to stored parts, indexes and the manifest, whole, in batches or as a stream.

A library is a `Store`. Its parts lie in one table, partitioned by the batch that wrote them and bucketed and sorted by
book, so whole books and windows are put together without moving parts. Its indexes lie beside them by batch. The manifest
says of each book which batch holds it, and a commit record which manifest counts; a batch that fails half-way leaves no
trace in it. Each file of a batch is unpacked, decoded and hashed once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import book_name, slug
from ..operators.chunking import PART_BYTES, book_index, chunk_parts, long_enough, part_path
from ..operators.manifest import merge_manifest, plan_changes, removed_books, with_status
from ..sources.library import Members, first_texts, zip_members
from ..sources.store import Store, small_batches

MANIFEST = "book_id string, hash string, title string, author string, total_chapters int, assets array<string>, batch long"
SCAN = "filename string, book_id string, hash string, title string, author string"
PENDING = "filename string, pos long"
INDEX = "book struct<id: string, title: string, author: string, totalChapters: int, parts: array<struct<path: string, size: bigint>>, totalSize: bigint>, chapters array<struct<id: string, title: string, byte_offset: bigint>>"
PARTS = "book_id string, part_no int, start_byte bigint, size bigint, content binary"
#: Buckets of the parts by book where the first run names no number, and files of a batch whose names are broadcast at most.
BUCKETS, BROADCAST_FILES = 16, 100_000
#: What describes a book besides its parts.
DESCRIBED = ("hash", "title", "author")

#: Archives (filename, content), or a function that reads those of the given names, or all where none are given.
Files = DataFrame | Callable[[list[str] | None], DataFrame]


def identified(files: DataFrame) -> DataFrame:
    """`files` (filename, content, ...) without content, with title, author, book_id and hash. Files without an id go."""
    rows = files.withColumn("hash", F.sha2("content", 256)).drop("content").withColumn("n", book_name(F.col("filename"))).select("*", "n.title", "n.author").drop("n")
    return rows.withColumn("book_id", slug(F.concat_ws("-", "title", "author"))).filter("book_id <> ''")


def named(files: DataFrame) -> DataFrame:
    """`identified` files, of those with the same id the last by name (of the same name: by hash) alone."""
    rows = identified(files.select("filename", "content"))
    rest = [c for c in rows.columns if c != "book_id"]
    return rows.groupBy("book_id").agg(F.max_by(F.struct(*rest), F.struct("filename", "hash")).alias("x")).select("book_id", "x.*")


def decoded_books(todo: DataFrame, contents: DataFrame, extract: Callable[[bytes], Members] = zip_members) -> DataFrame:
    """The rows of `todo` (filename, hash, ...) whose files can be used, with their text; only these of `contents` (filename, content) are unpacked. A file that `contents` holds twice comes twice."""
    files = contents.select("filename", "content", F.sha2("content", 256).alias("hash"))
    return long_enough(first_texts(files.join(todo, ["filename", "hash"]), extract))


def described(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexes, manifest rows without batch) of the books `rows` (book_id, parts, total_size, hash, title, author)."""
    book = F.struct(F.col("book_id").alias("id"), "title", "author", F.lit(0).alias("totalChapters"), "parts", F.col("total_size").alias("totalSize"))
    indexes = rows.select(book.alias("book"), F.expr("cast(array() as array<struct<id: string, title: string, byte_offset: bigint>>)").alias("chapters"))
    own = F.concat(F.lit("/data/"), F.col("book_id"), F.lit("_chapters.json"))
    assets = F.concat(F.array(own), F.transform("parts", lambda p: p["path"]))
    return indexes, rows.select("book_id", "hash", "title", "author", F.lit(0).alias("total_chapters"), assets.alias("assets"))


def ingest(files: DataFrame, manifest: DataFrame, artifacts: DataFrame, part_bytes: int = PART_BYTES, extract: Callable[[bytes], Members] = zip_members) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, indexes, manifest rows) of the new and changed of `files` (filename, content). One plan, nothing is stored; what describes a book goes with its parts, so each text is read once."""
    todo = with_status(named(files), manifest, artifacts).filter("status <> 'current'").drop("status")
    books = decoded_books(todo, files, extract).dropDuplicates(["book_id"])
    return chunk_parts(books, part_bytes, content=True), *described(book_index(chunk_parts(books, part_bytes, carry=DESCRIBED), DESCRIBED))


def parts_table(spark: SparkSession, root: str, buckets: int | None = None) -> str:
    """The name, in this session, of the table of all stored parts of a library, live or not. The number of buckets is that of the library's first run."""
    store = Store(spark, root)
    store.make("parts")
    buckets = store.last().get("buckets", buckets or BUCKETS)
    name = f"quire_parts_{hashlib.sha256(f'{root.rstrip("/")} {buckets}'.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"create table {name} ({PARTS.replace('bigint', 'long')}, batch long) using parquet options (compression 'zstd') partitioned by (batch) clustered by (book_id) sorted by (book_id, part_no) into {buckets} buckets location '{root.rstrip('/')}/parts'")
    return name


def refresh(spark: SparkSession, name: str) -> None:
    """Let the session see the parts' folders as they are: other sessions write and sweep them too."""
    spark.sql(f"msck repair table {name} sync partitions")
    spark.catalog.refreshTable(name)


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    """The manifest that counts."""
    store = Store(spark, root)
    return store.read("manifest", store.last().get("manifest"), MANIFEST)


def live_parts(spark: SparkSession, root: str) -> DataFrame:
    """Parts (book_id, part_no, start_byte, size, content) of the books of the manifest, hashed by book as they are stored.

    The batches are compared by a difference, as an equality would make Spark deal the parts anew by both columns.
    """
    name, books = parts_table(spark, root), manifest_of(spark, root).select(F.col("book_id").alias("_book"), F.col("batch").alias("_batch"))
    refresh(spark, name)
    rows = spark.table(name).filter(F.col("batch") <= Store(spark, root).last()["number"]).join(books, (F.col("book_id") == F.col("_book")) & (F.col("batch") - F.col("_batch") == 0))
    return rows.select(*[c.split()[0] for c in PARTS.split(", ")])


def live_indexes(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """Indexes (book, chapters) of the books of the manifest."""
    store, manifest = Store(spark, root), manifest if manifest is not None else manifest_of(spark, root)
    last = store.last()["number"]
    places = [store.place("indexes", x) for x in store.children("indexes") if x.startswith("batch=") and int(x[6:]) <= last]  # not what a lost writer has left
    if not places:
        return spark.createDataFrame([], INDEX)
    rows = spark.read.schema(f"{INDEX}, batch long").option("basePath", f"{store.root}/indexes").parquet(*places)
    return rows.join(manifest.select(F.col("book_id").alias("_book"), F.col("batch").alias("_batch")), (F.col("book.id") == F.col("_book")) & (F.col("batch") == F.col("_batch"))).select("book", "chapters")


def store_books(store: Store, number: int, todo: DataFrame, contents: DataFrame, part_bytes: int, buckets: int, extract: Callable[[bytes], Members]) -> DataFrame:
    """Write the parts and indexes of the books of `todo` (..., turn) as those of batch `number`; their manifest rows. Of the usable versions of a book the one with the last turn stays."""
    spark, name = store.spark, parts_table(store.spark, store.root, buckets)
    if todo.isEmpty():
        return spark.createDataFrame([], MANIFEST)
    chosen = F.broadcast(todo) if todo.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES else todo
    books = store.write(decoded_books(chosen, contents, extract).select("book_id", *DESCRIBED, "turn", "text"), "work", number)
    if not books.groupBy("book_id").count().filter("count > 1").isEmpty():
        rest = [*DESCRIBED, "turn", "text"]
        books = books.groupBy("book_id").agg(F.max_by(F.struct(*rest), "turn").alias("x")).select("book_id", "x.*")
    store.remove([f"parts/batch={number}"])
    parts = chunk_parts(books, part_bytes, content=True).withColumn("batch", F.lit(number).cast("long"))
    refresh(spark, name)
    with small_batches(spark):
        parts.repartition(buckets, "book_id").write.insertInto(name)
    refresh(spark, name)
    indexes, rows = described(book_index(spark.table(name).filter(F.col("batch") == number).select("book_id", "part_no", "size")).join(books.select("book_id", *DESCRIBED), "book_id"))
    store.write(indexes, "indexes", f"batch={number}")
    return store.write(rows.withColumn("batch", F.lit(number).cast("long")), "processed", number)


def finish(store: Store, number: int, manifest: DataFrame, done: DataFrame, files: DataFrame, record: dict) -> dict:
    """Write the manifest that follows `manifest` and the record; the counters with what has been removed."""
    following = store.write(merge_manifest(manifest, done, files), "manifest", number)
    record["counters"] |= {"removed": removed_books(manifest, following).count(), "books": following.count()}
    store.commit(number, record | {"manifest": number})
    store.remove([f"work/{number}", f"processed/{number}"])
    return record["counters"]


def run_batch(files: Files, root: str, size: int | None = 50, part_bytes: int = PART_BYTES, extract: Callable[[bytes], Members] = zip_members, buckets: int = BUCKETS) -> dict[str, int]:
    """One batch of an incremental run over the library under `root`; counters of what it did.

    The first batch names and hashes all files and lists those to process (pending) by their names; the following ones
    take the next `size` of that list (all for None) without looking at other files. A book is processed if it is new, its file has
    changed, or its index is gone. Books that can't be used count as failed; one that was usable before stays as it was.
    Without any file nothing changes. Books whose files are gone leave the manifest with the first batch.
    """
    reader = files if callable(files) else lambda names: files
    spark = files.sparkSession if isinstance(files, DataFrame) else SparkSession.active()
    store = Store(spark, root)
    last = store.last()
    buckets = last.get("buckets", buckets)
    number, manifest = last["number"] + 1, store.read("manifest", last.get("manifest"), MANIFEST)
    at, scanned, listed = last.get("position", 0), last.get("scan"), last.get("pending")
    if listed is None:
        scan = store.write(named(reader(None)).select("filename", "book_id", "hash", "title", "author"), "scan", number)
        if scan.isEmpty():
            return {"processed": 0, "failed": 0, "remaining": 0, "batches": 0, "removed": 0, "books": manifest.count()}
        made = live_indexes(spark, root, manifest).select(F.col("book.id").alias("book_id"))
        todo = scan.join(plan_changes(scan, manifest, made).filter("status <> 'current'").select("book_id"), "book_id", "left_semi")
        order = todo.select("filename").repartitionByRange("filename").sortWithinPartitions("filename")
        pending = store.write(order.withColumn("pos", F.monotonically_increasing_id()), "pending", number)
        at, scanned, listed = -1, number, number
    else:
        scan, pending = store.read("scan", scanned, SCAN), store.read("pending", listed, PENDING)
    rest = pending.filter(F.col("pos") > at)
    total, end = rest.agg(F.count("*"), F.max("pos")).first()
    size = max(1, total) if size is None else size
    if size < total:
        end = rest.orderBy("pos").limit(size).agg(F.max("pos")).first()[0]  # the batch is the feature
    chosen = rest.filter(F.col("pos") <= (end if end is not None else at)).select("filename")
    names = [r[0] for r in chosen.collect()] if callable(files) else None  # `size` names
    done = store_books(store, number, scan.join(chosen, "filename", "left_semi").withColumn("turn", F.lit(1)), reader(names), part_bytes, buckets, extract)
    taken, kept = min(size, total), done.count()
    left = total - taken
    counters = {"processed": kept, "failed": taken - kept, "remaining": left, "batches": math.ceil(left / size)}
    return finish(store, number, manifest, done, scan, {"counters": counters, "scan": scanned if left else None, "pending": listed if left else None, "position": end, "buckets": buckets, "epoch": last.get("epoch", -1)})


def ingest_stream(files: DataFrame, root: str, part_bytes: int = PART_BYTES, extract: Callable[[bytes], Members] = zip_members, buckets: int = BUCKETS) -> None:
    """Runs the stream `files` (filename, content[, arrived]) of arriving archives as far as it has input, a commit for each micro-batch.

    Of several arrivals of a book in one micro-batch the last usable one counts, as if each had come by itself: by
    `arrived`, which micro-batches must follow too, then name and hash. Arrivals that are new or changed are stored; no book goes. The record of a commit holds the micro-batch's number, so
    one that is repeated after a loss is skipped if it was committed, and written anew if it wasn't.
    """
    spark = files.sparkSession

    def arrived(batch: DataFrame, epoch: int) -> None:
        store = Store(spark, root)
        last = store.last()
        if last.get("epoch", -1) >= epoch:
            return
        own = last.get("buckets", buckets)
        number, manifest = last["number"] + 1, store.read("manifest", last.get("manifest"), MANIFEST)
        by = W.partitionBy("book_id").orderBy(*[c for c in ("arrived", "filename", "hash") if c in ("hash", *batch.columns)])
        scan = store.write(identified(batch).withColumn("turn", F.row_number().over(by)).select("filename", "book_id", "hash", "title", "author", "turn"), "scan", number)
        made = live_indexes(spark, root, manifest).select(F.col("book.id").alias("book_id"))
        todo = scan.join(plan_changes(scan, manifest, made).filter("status <> 'current'").select("book_id"), "book_id", "left_semi")
        done = store_books(store, number, todo, batch.select("filename", "content"), part_bytes, own, extract)
        count, kept = todo.select("book_id").distinct().count(), done.count()
        keep = {k: last.get(k) for k in ("scan", "pending", "position")}  # a run of batches that isn't over goes on
        finish(store, number, manifest, done, manifest.select("book_id").union(scan.select("book_id")), {**keep, "counters": {"processed": kept, "failed": count - kept}, "buckets": own, "epoch": epoch})

    files.writeStream.foreachBatch(arrived).option("checkpointLocation", f"{root.rstrip('/')}/stream").trigger(availableNow=True).start().awaitTermination()


def unreferenced(spark: SparkSession, root: str) -> DataFrame:
    """(kind, book_id, batch) of the stored parts and indexes that the manifest doesn't name."""
    manifest, name = manifest_of(spark, root).select("book_id", "batch"), parts_table(spark, root)
    refresh(spark, name)
    found = spark.table(name).select(F.lit("parts").alias("kind"), "book_id", "batch")
    if Store(spark, root).children("indexes"):
        found = found.union(spark.read.schema(f"{INDEX}, batch long").parquet(f"{root.rstrip('/')}/indexes").select(F.lit("index"), "book.id", "batch"))
    return found.distinct().join(manifest, ["book_id", "batch"], "left_anti").select("kind", "book_id", "batch")


def sweep(spark: SparkSession, root: str, grace: int = 2, dead_share: float = 0.0) -> dict[str, int]:
    """Mark and sweep: what none of the last `grace` manifests names is deleted; counters of what went.

    Batches that hold more than `dead_share` of books the manifest no longer names are marked; the books of them that it
    does name are written together as a new batch, in a commit of its own. Then the folders of all batches without a
    reference go. Readers that began with one of the last `grace` manifests find all of its parts.
    """
    store = Store(spark, root)
    last = store.last()
    manifest, name = store.read("manifest", last.get("manifest"), MANIFEST), parts_table(spark, root)
    refresh(spark, name)
    held = spark.table(name).select("book_id", "batch").distinct()
    shares = held.join(manifest.select("book_id", "batch", F.lit(1).alias("live")), ["book_id", "batch"], "left").groupBy("batch").agg(F.count("*").alias("n"), F.count("live").alias("live"))
    marked = [r.batch for r in shares.filter((F.col("live") > 0) & (F.col("n") - F.col("live") > F.col("n") * dead_share)).collect()]  # a row a batch
    if marked:
        number = last["number"] + 1
        moved = manifest.filter(F.col("batch").isin(marked))
        kept = moved.select(F.col("book_id").alias("_book"), F.col("batch").alias("_batch"))
        store.remove([f"parts/batch={number}"])
        rows = spark.table(name).filter(F.col("batch").isin(marked)).join(kept, (F.col("book_id") == F.col("_book")) & (F.col("batch") - F.col("_batch") == 0)).drop("_book", "_batch")
        rows.withColumn("batch", F.lit(number).cast("long")).write.insertInto(name)
        store.write(live_indexes(spark, root, moved), "indexes", f"batch={number}")
        store.write(manifest.withColumn("batch", F.when(F.col("batch").isin(marked), F.lit(number).cast("long")).otherwise(F.col("batch"))), "manifest", number)
        store.commit(number, {**{k: v for k, v in last.items() if k != "number"}, "manifest": number})
        refresh(spark, name)
    records = [store.record(n) for n in store.numbers()[-grace:]]
    manifests = {r["manifest"] for r in records if r.get("manifest") is not None}
    used = {r[0] for m in manifests for r in store.read("manifest", m, MANIFEST).select("batch").distinct().collect()}
    number = store.last()["number"]
    gone = {kind: [f"{kind}/{x}" for x in store.children(kind) if x.startswith("batch=") and (b := int(x[6:])) not in used and b <= number] for kind in ("parts", "indexes")}
    tables = {kind: {r.get(kind) for r in records} for kind in ("manifest", "scan", "pending")}
    old = [f"{kind}/{x}" for kind, live in tables.items() for x in store.children(kind) if x.isdigit() and int(x) not in live and int(x) <= number]
    store.forget(grace)
    store.remove([*gone["parts"], *gone["indexes"], *old])
    refresh(spark, name)
    return {"moved": len(marked), "parts": len(gone["parts"]), "indexes": len(gone["indexes"]), "tables": len(old)}
