"""The library's own queries over the driver's tables, with DuckDB SQL for each that SQL can express.

Documents are books (doc_id, text, source as author), events are saves of reading progress, parts are a catalogue. Older
snapshots are derived from the tables by language, so every row takes part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .functions import encoding, text
from .operators import asof, catalog, chunking, headings, manifest, progress, quality, reader
from .plans.ingest import ingest, ingest_stream, live_indexes, live_parts, manifest_of, run_batch, sweep, unreferenced
from .sources import library
from .sources.store import small_batches
from .operators.search_index import SearchIndex
from .streaming.progress import emit_moved, keep_most_recent, settle, shared_folder

#: Part size of the queries; the texts are far smaller than a part of the default size.
PART = 2048


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr("doc_id book_id", "text", "lang", "source author")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", "lang", "author", F.sha2("text", 256).alias("hash"))


# Chapter titles from the catalogue: the same SQL for both engines.
TITLES = """select p_brand book_id, p_partkey line_no, case p_size % 8
    when 0 then '第' || p_size || '卷 ' || p_type when 1 then '第' || p_size || '章 ' || p_name when 2 then p_name || '，' || p_type || '，' || p_name || '。'
    when 3 then '第' || p_size || '章 第' || p_size || '节 ' || p_name when 4 then '楔子' when 5 then '第一卷 第二部 ' || p_name
    when 6 then p_name || '，a，b，c，d，e' when 7 then repeat(p_name || ' ', 1 + p_size % 9) || '章' else '第' || p_size || '章' end title from part"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, line_no, title)."""
    return spark.sql(TITLES.replace("from part", "from {p}"), p=load(spark, sf_dir, "part"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles numbered in their book."""
    return titles(spark, sf_dir).selectExpr("book_id", "cast(row_number() over (partition by book_id order by line_no) as bigint) chapter", "title")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).withColumnRenamed("title", "line")


# Lines of seven books with headings of all kinds: the same SQL for both engines.
BOOK_LINES = """select cast(p_partkey % 7 as bigint) book_id, p_partkey line_no, case when p_partkey % 7 = 3 and p_partkey > 60 then '第' || p_partkey || '卷 ' || p_type else case p_partkey % 23
    when 0 then '第' || p_size || '卷 ' || p_type when 1 then '第' || p_size || '章 ' || p_name when 2 then p_name || '，' || p_type || '，' || p_name || '。' when 3 then '第' || p_size || '章 第' || p_size || '节 ' || p_name
    when 4 then '楔子' when 5 then '第一卷 第二部 ' || p_name when 6 then p_size || '章 ' || p_name when 7 then '章' || p_size || '：' || p_name when 8 then '第三　回　' || p_name when 9 then '三回 ' || p_name
    when 10 then 'Chapter ' || p_size || ': ' || p_name when 11 then 'Book ' || p_size || ' ' || p_name when 12 then '【' || p_name || '】' when 13 then '【' || p_brand || '】 第IV章' || p_name when 14 then '尾声 ' || p_name || '，' || p_type || '，' || p_type || '。'
    when 15 then '第' || p_size || '章 ' || p_name || '，' || p_type || '！！' when 16 then '第' || p_size || '章上 ' || p_name || '，' || p_type || '，' || p_name || '，' || p_brand || '？' when 17 then '  第七节——' || p_name when 18 then '' when 19 then '第' || p_size || '章' || p_name
    when 20 then '部十二 ' || p_name when 21 then '第' || p_size || '章　　“' || p_name || '”' else p_name end end line from part"""


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, line_no, line)."""
    return spark.sql(BOOK_LINES.replace("from part", "from {p}"), p=load(spark, sf_dir, "part"))


def chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_parts(books(spark, sf_dir), PART)


def part_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.part_offsets(chunk_parts(spark, sf_dir).drop("start_byte"))


def book_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.book_index(chunk_parts(spark, sf_dir))
    return out.select("book_id", F.array_join(F.transform("parts", lambda p: F.concat(p["path"], F.lit(":"), p["size"].cast("string"))), " ").alias("parts"), "total_size")


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.whole_texts(chunking.chunk_parts(books(spark, sf_dir), PART, content=True)).select("book_id", F.sha2("content", 256).alias("sha256"))


def read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = books(spark, sf_dir)
    windows = own.filter("octet_length(text) > 0").selectExpr("book_id window_id", "book_id", "cast(book_id * 7919 % octet_length(text) as bigint) start_byte", "3000L length")
    out = reader.read_windows(windows, chunking.chunk_parts(own, PART, content=True))
    return out.select("book_id", "start_byte", F.lower(F.hex("content")).alias("bytes"))


def reader_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir).selectExpr("book_id", "cast(coalesce(octet_length(text), 0) * 200L as bigint) total").withColumn("saved", (F.col("book_id") * 7919 % (F.col("total") + 1)).cast("long"))
    first = reader.restored(F.col("saved"), F.col("total"))
    last = reader.moved(first, F.array(*map(F.lit, ("down", "down", "up"))), F.col("total"))
    return rows.select("book_id", "saved", first.alias("a"), last.alias("b")).select("book_id", "saved", F.col("a.s").alias("start_1"), F.col("a.e").alias("end_1"), F.col("b.s").alias("start_2"), F.col("b.e").alias("end_2"))


def progress_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir).selectExpr("book_id", "text", "cast(coalesce(octet_length(text), 0) as bigint) total").withColumn("at", (F.col("book_id") * 131 % (F.col("total") + 1)).cast("long"))
    return rows.select("book_id", text.percent(F.col("at"), F.col("total")).alias("percent"), text.preview(F.col("text")).alias("preview"), text.mib_label(F.col("total")).alias("mib"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("book_id", "hash")


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, the manifest of an older run that knew no French and other German texts, and the indexes that it left."""
    files = hashed(spark, sf_dir)
    old = files.filter("lang <> 'fr'").withColumn("hash", F.when(F.col("lang") == "de", "old").otherwise(F.col("hash")))
    gone = files.filter("lang = 'es'").withColumn("book_id", -F.col("book_id") - 1)
    return files, old.unionByName(gone), old.filter("lang <> 'es'").select("book_id")


def plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.plan_changes(*_snapshot(spark, sf_dir))


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, old, _ = _snapshot(spark, sf_dir)
    new = files.filter("lang in ('fr', 'de')").withColumn("hash", F.concat(F.lit("v2-"), "hash"))
    return manifest.merge_manifest(old, new.select(old.columns), files).select("book_id", "hash", "lang")


def removed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, old, _ = _snapshot(spark, sf_dir)
    return manifest.removed_books(old, files).select("book_id", "hash")


def obsolete_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = books(spark, sf_dir)
    assets = lambda size: chunking.chunk_parts(own, size).groupBy("book_id").agg(F.collect_list(chunking.part_path()).alias("assets"))
    return manifest.obsolete_assets(assets(PART), assets(2 * PART))


def pending_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.batches(books(spark, sf_dir).select("book_id"), 50, "book_id")


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select(text.slug(F.concat_ws("-", "p_name", "p_brand")).alias("book_id"), F.col("p_partkey").alias("pos"))
    return manifest.duplicate_ids(parts)


def min_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.long_enough(books(spark, sf_dir)).select("book_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("book_id", text.slug(F.get(F.split("text", "\n", -1), F.lit(0))).alias("slug"))


def parse_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_size > 25, concat('《', p_name, '》全本 作者：', p_brand, '.rar'), concat(p_name, '.RAR')) filename")
    return names.select("p_partkey", text.book_name(F.col("filename")).alias("n")).select("p_partkey", "n.title", "n.author", text.slug(F.concat_ws("-", "n.title", "n.author")).alias("book_id"))


def charset_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir).select("book_id", encoding.class_counts(F.col("text")).alias("c"))
    return rows.select("book_id", "c.*", encoding.plausible(F.col("c")).alias("plausible"))


@F.pandas_udf(BinaryType())
def _marked(content: pd.Series, lang: pd.Series) -> pd.Series:
    """A text as a file of another character set, by language."""
    forms = {"fr": ("utf-8-sig", b""), "de": ("utf-16-le", b"\xff\xfe"), "es": ("utf-16-be", b"\xfe\xff")}
    return content.combine(lang, lambda t, x: (lambda c: c[1] + (t or "").encode(c[0]))(forms.get(x, ("utf-8", b""))))


def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir).select("book_id", _marked("text", "lang").alias("content"))
    rows = rows.withColumn("charset", encoding.charset(F.col("content")))
    return rows.select("book_id", "charset", F.sha2(encoding.decoded("content", "charset"), 256).alias("sha256"))


# Texts of four languages, written in the character sets of these without a mark.
LEGACY = (
    ("gb18030", "天色渐渐暗了下来，他站在窗前望着远处的山峦，心里想着明天的旅程。"), ("big5", "天色漸漸暗了下來，他站在窗前望著遠處的山巒，心裡想著明天的旅程。"),
    ("shift_jis", "空がだんだん暗くなり、彼は窓の前に立って遠くの山を眺めながら、明日の旅のことを考えていた。"), ("euc-kr", "하늘이 점점 어두워지자 그는 창가에 서서 먼 산을 바라보며 내일의 여행을 생각했다."),
)


@F.pandas_udf(BinaryType())
def _encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    return text.combine(charset, lambda t, c: t.encode(c))


def legacy_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character sets of unmarked texts of 12 characters to a whole sentence, between the ASCII words of the documents."""
    of = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in LEGACY]), (F.col("book_id") % 4 + 1).cast("int"))
    words = F.regexp_replace(F.substring("text", 1, 60), r"[^\x00-\x7f]", "")
    rows = books(spark, sf_dir).select("book_id", of(0).alias("form"), F.concat(F.coalesce(words, F.lit("")), F.substr(of(1), F.lit(1), (F.col("book_id") % 30 + 12).cast("int"))).alias("text"))
    rows = rows.select("book_id", _encoded("text", "form").alias("content")).withColumn("charset", encoding.charset(F.col("content")))
    return rows.select("book_id", "charset", F.sha2(encoding.decoded("content", "charset"), 256).alias("sha256"))


def _zipped(batches):
    """Archives of one text member each, after a folder and a blank member."""
    import io
    import zipfile

    for batch in batches:
        out, size, start = [], 0, 0
        for i, t in enumerate(batch["text"]):
            with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
                for name, data in (("book/", b""), ("a.txt", b" \n"), ("book/b c?.TXT", (t.as_py() or "").encode()), ("..", b""), ("x\\a.txt", b"")):
                    z.writestr(zipfile.ZipInfo(name), data)  # without the time, so that the same text gives the same file
            out.append(held.getvalue())
            size += len(out[-1])
            if size > library.STEP_BYTES or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch["filename"].slice(start, len(out)), pa.array(out, pa.binary())], ["filename", "content"])
                out, size, start = [], 0, i + 1
    library.give_back()


def _archived(rows: DataFrame) -> DataFrame:
    """(filename, content) of books (book_id, text, author), packed by all cores, however few files the texts lie in."""
    named = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "book_id").select(F.concat(F.lit("《b"), F.col("book_id").cast("string"), F.lit("》作者："), "author", F.lit(".rar")).alias("filename"), "text")
    return named.mapInArrow(_zipped, "filename string, content binary")


def _filed(rows: DataFrame, place: str) -> DataFrame:
    """`_archived` books as a stored table, so that they are packed once, however often a run reads them."""
    with small_batches(rows.sparkSession):
        _archived(rows).write.parquet(place)
    return rows.sparkSession.read.schema("filename string, content binary").parquet(place)


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(books(spark, sf_dir))


def extract_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each archive, and the safe names of its members."""
    found = library.safe_names(library.members_of(_archives(spark, sf_dir))).withColumn("text", encoding.decoded("content", encoding.charset(F.col("content")))).cache()
    names = found.groupBy("filename").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("member_pos", "safe_name"))), lambda x: x["safe_name"]), " ").alias("names"))
    return library.first_text(found).join(names, "filename").select("filename", F.sha2("text", 256).alias("sha256"), "names")


def ingest_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over all archives in one batch: the manifest that it leaves."""
    root = f"{shared_folder(spark)}/quire-library-{uuid.uuid4().hex}"
    run_batch(_filed(books(spark, sf_dir), f"{root}-files"), root, None, PART)
    return manifest_of(spark, root).select("book_id", "title", "author", (F.size("assets") - 1).cast("long").alias("n_assets"))


def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexes of all archives by one plan that stores nothing."""
    files, none = _archives(spark, sf_dir), spark.createDataFrame([], "book_id string, hash string")
    indexes = ingest(files, none, none.select("book_id"), PART)[1]
    return indexes.select("book.id", "book.title", "book.author", F.size("book.parts").cast("long").alias("n_parts"), F.col("book.totalSize").alias("total_size"))


def _runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Archives of three runs: without French; all, with German texts that have grown; without Spanish."""
    own = books(spark, sf_dir)
    grown = own.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("\nnew line\nlast line"))).otherwise(F.col("text")))
    return [own.filter("lang <> 'fr'"), grown, grown.filter("lang <> 'es'")]


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """What a library holds of each book: parts, index and manifest, and how much that none of these needs."""
    parts = live_parts(spark, root)
    texts = chunking.whole_texts(parts).select("book_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))
    counts = parts.groupBy("book_id").agg(F.count("*").alias("n_parts"))
    indexes = live_indexes(spark, root).select(F.col("book.id").alias("book_id"), F.array_join(F.transform("book.parts", lambda p: F.concat_ws(":", p["path"], p["size"].cast("string"))), " ").alias("parts"), F.col("book.totalSize").alias("total_size"))
    own = manifest_of(spark, root).select("book_id", "title", "author", F.array_join("assets", " ").alias("assets"))
    return own.join(texts, "book_id", "full").join(counts, "book_id", "full").join(indexes, "book_id", "full").withColumn("unreferenced", F.lit(unreferenced(spark, root).count()))


def ingest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of two batches each with additions, changes and removals, then a sweep: all that is stored."""
    root = f"{shared_folder(spark)}/quire-library-{uuid.uuid4().hex}"
    for i, rows in enumerate(_runs(spark, sf_dir)):
        files, left = _filed(rows, f"{root}-files-{i}"), True
        size = rows.count() // 2 + 1
        while left:
            left = run_batch(files, root, size, PART)["remaining"]
    sweep(spark, root, grace=1)
    return _stored(spark, root)


def ingest_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that arrive in files of a folder, taken up as a stream of micro-batches: all that is stored."""
    root = f"{shared_folder(spark)}/quire-library-{uuid.uuid4().hex}"
    for i, rows in enumerate(_runs(spark, sf_dir)[:2]):
        with small_batches(spark):
            _archived(rows).repartition(3).write.mode("append").parquet(f"{root}-arrivals")
    stream = spark.readStream.schema("filename string, content binary").option("maxFilesPerTrigger", 2).parquet(f"{root}-arrivals")
    ingest_stream(stream.select("*", F.col("_metadata.file_modification_time").alias("arrived")), root, PART)
    sweep(spark, root, grace=1)
    return _stored(spark, root)


def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows read from the stored parts of a library."""
    root = f"{shared_folder(spark)}/quire-library-{uuid.uuid4().hex}"
    run_batch(_filed(books(spark, sf_dir), f"{root}-files"), root, None, PART)
    sizes = live_indexes(spark, root).select(F.col("book.id").alias("book_id"), F.col("book.totalSize").alias("total"))
    windows = sizes.select(F.col("book_id").alias("window_id"), "book_id", (F.octet_length("book_id") * 7919 % F.col("total")).cast("long").alias("start_byte"), F.lit(3000).cast("long").alias("length"))
    return reader.read_windows(windows, live_parts(spark, root)).select("book_id", "start_byte", F.lower(F.hex("content")).alias("bytes"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) book_id", "p_name title", "p_brand author", "0 total_chapters", "p_partkey pos")


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.from_rows(catalog.to_rows(catalog.summaries(_catalog(spark, sf_dir))))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "documents").selectExpr("doc_id book_id", "lang title", "source author")
    return own.join(chunking.book_index(chunk_parts(spark, sf_dir)), "book_id").selectExpr("cast(book_id as string) id", "title", "author", "parts", "total_size totalSize")


def compat_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.to_compat(_flat(spark, sf_dir)).select("book.id", "book.title", "book.author", "book.totalChapters", F.size("book.parts").cast("long").alias("n_parts"), "book.totalSize", F.size("chapters").cast("long").alias("n_chapters"))


def strip_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = catalog.to_compat(_flat(spark, sf_dir)).withColumn("chapters", F.when(F.col("book.title") == "en", F.array(F.col("book.id"))).otherwise(F.col("chapters")))
    return catalog.strip_chapters(full).select("book.id", F.size("chapters").cast("long").alias("n_chapters"))


def search_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_catalog(spark, sf_dir), " Red wid ").unionByName(catalog.search(_catalog(spark, sf_dir), "BRAND 2")).distinct().select("book_id", "title", "author")


def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(catalog.search(_catalog(spark, sf_dir), "bolt"), 2, "pos").select("book_id", "title")


def _saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("user_id", "get_json_object(props, '$.k') book_id", "ts updated_at", "event_id seq", "value")


def progress_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = "to_json(named_struct('bookId', get_json_object(props, '$.k'), 'chapterId', if(event_type = 'error', null, event_type), 'updatedAt', if(value > 50, null, timestampdiff(millisecond, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))), 'scrollPosition', event_id)) json"
    stored = load(spark, sf_dir, "events").selectExpr("user_id", "event_id seq", entry)
    return progress.read_entries(stored, F.timestamp_millis(F.lit(1893456000000))).select("user_id", "seq", "book_id", "chapter_id", F.unix_millis("updated_at").alias("updated_ms"))


def progress_mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.most_recent(_saves(spark, sf_dir)).select("user_id", "book_id", "seq", F.col("place").cast("long").alias("place"))


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.most_recent(_saves(spark, sf_dir), progress.SHOWN).select("user_id", "book_id", text.minute_label(F.col("updated_at")).alias("label"))


def book_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) book_id")
    return progress.books_with_progress(own, _saves(spark, sf_dir)).select("book_id", "readers", F.expr("timestampdiff(millisecond, timestamp_ntz'1970-01-01', cast(entry.updated_at as timestamp_ntz))").alias("last_ms"), F.col("entry.user_id").alias("reader"), F.col("entry.seq").alias("seq"))


def progress_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entries of readers in books, of which every second book's name is one that nobody reads."""
    asked = _saves(spark, sf_dir).select("user_id", F.when(F.col("seq") % 2 == 0, F.col("book_id")).otherwise(F.concat("book_id", F.lit("?"))).alias("book_id")).distinct()
    return progress.entries_of(asked, _saves(spark, sf_dir)).select("user_id", "book_id", "seq", F.round("value", 6).alias("value"))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "events")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    saves = stream.selectExpr("user_id", "get_json_object(props, '$.k') book_id", "ts updated_at", "event_id seq", "value")
    return keep_most_recent(saves, f"{shared_folder(spark)}/quire-progress-{uuid.uuid4().hex}").select("user_id", "book_id", "seq", F.col("place").cast("long").alias("place"))


def title_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.title_stats(chapters(spark, sf_dir))


def marker_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.marker_usage(chapters(spark, sf_dir))


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_titles(chapters(spark, sf_dir))


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issues(chapters(spark, sf_dir))


def issue_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_issues(quality.issues(chapters(spark, sf_dir))).select("book_id", "type", "chapter", "title", "shown", F.col("place").cast("long").alias("place"), F.col("more").cast("long").alias("more"))


def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chapters(spark, sf_dir)
    return quality.library_summary(own, quality.issues(own)).select("books", "chapters", "issues", F.round("quality", 6).alias("quality"), "verdict")


def heading_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.marker_counts(lines(spark, sf_dir))


def heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.hierarchy(book_lines(spark, sf_dir)).select("book_id", F.array_join("upper", "").alias("upper"), F.array_join("primary", "").alias("primary"))


def heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of chapter headings, and their scores."""
    own = book_lines(spark, sf_dir)
    rows = headings.chapter_candidates(headings.segments(own, headings.hierarchy(own))).filter("chapter is not null").select("book_id", "line_no", "part", "line", F.col("chapter.base").alias("base"), F.col("chapter.rest").alias("rest"), F.col("chapter.sep").alias("sep"))
    return rows.select("book_id", "line_no", F.col("part").cast("long").alias("part"), F.round(headings.confidence("line", F.col("base"), "rest", "sep"), 6).alias("score"))


def chapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.detect_chapters(book_lines(spark, sf_dir)).select("book_id", F.col("chapter").cast("long").alias("chapter"), "title", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue documents of two layouts, decoded by their headers."""
    row = lambda names: f"array_sort(collect_list(array({', '.join(names)})))"
    fields = {"id": "cast(p_partkey as string)", "title": "p_name", "author": "p_brand", "totalChapters": "cast(p_size as string)"}
    form = lambda names: f"to_json(named_struct('generatedAt', '2025-01-01T00:00:00.000Z', 'columns', array({', '.join(map(repr, names))}), 'books', {row([fields[n] for n in names])}))"
    documents = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.expr(f"if(crc32(cast(p_brand as binary)) % 2 = 0, {form(list(fields))}, {form(list(fields)[::-1])})").alias("json"))
    return catalog.decode_documents(documents.select("json").union(spark.sql("select '{broken' json")))


def catalog_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written and read back."""
    folder = f"{shared_folder(spark)}/quire-catalog-{uuid.uuid4().hex}"
    catalog.write_catalog(catalog.summaries(_catalog(spark, sf_dir)), folder, F.lit("2025-01-01T00:00:00.000Z"))
    return catalog.read_catalog(spark, folder)


def manifest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest documents taken apart by book."""
    books_of = "map_from_entries(collect_list(struct(cast(p_partkey as string), named_struct('hash', sha2(p_name, 256), 'title', p_name, 'assets', array(p_type, p_brand)))))"
    documents = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.expr(f"to_json(named_struct('books', {books_of}))").alias("json"))
    return catalog.manifest_books(documents, "hash: string, title: string, assets: array<string>").select("book_id", "hash", "title", F.array_join("assets", "|").alias("assets"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").selectExpr("case p_partkey % 4 when 0 then concat('b', p_partkey, '_chapters.json') when 1 then concat('b', p_partkey, '.json') when 2 then 'books_chapters.json' else concat(p_partkey, '_chapters.json.bak') end filename")
    return catalog.named_files(names, "_chapters.json", "books_chapters.json")


def config_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 3 when 0 then props when 1 then substring(props, 1, 4) end json")
    return rows.select("event_id", catalog.or_default(F.col("json"), "k string", F.struct(F.lit("none").alias("k")))["k"].alias("k"))


def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of an incremental run's batches until nothing is pending."""
    root = f"{shared_folder(spark)}/quire-run-{uuid.uuid4().hex}"
    files = _filed(books(spark, sf_dir), f"{root}-files")
    size, counters = (files.count() * 2 + 4) // 5, []
    while not counters or counters[-1]["remaining"]:
        counters.append({"run": len(counters) + 1} | run_batch(files, root, size, PART))
    return spark.createDataFrame(pd.DataFrame(counters))


def fallback_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest without the books whose chapters are fallback ones: here those that aren't English."""
    own = fallback_chapters(spark, sf_dir).join(books(spark, sf_dir).select("book_id", "lang"), "book_id")
    named = own.withColumn("title", F.when(F.col("lang") == "en", F.concat(F.lit("第一章 "), "title")).otherwise(F.col("title")))
    return manifest.without_books(hashed(spark, sf_dir).select("book_id", "hash"), headings.fallback_books(named))


def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_counts(chapters(spark, sf_dir))


def repeated_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_chapters(chapters(spark, sf_dir))


def scroll_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").selectExpr("user_id", "get_json_object(props, '$.k') book_id", "event_id seq", "event_id * 37 % 1000 position")
    return progress.moved(rows)


def settled_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").selectExpr("user_id", "event_id", "timestampdiff(millisecond, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz)) ms")
    return progress.settled(rows, "user_id", "ms", "event_id", 600_000)


def _in_turn(spark: SparkSession, rows: list[DataFrame], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream `run` makes of `rows` that arrive one table after the other: a folder of files as its sink."""
    root = f"{shared_folder(spark)}/quire-stream-{uuid.uuid4().hex}"
    schema = rows[0].schema
    for table in rows:
        table.write.mode("append").parquet(f"{root}/in")
        out = run(spark.readStream.schema(schema).parquet(f"{root}/in"))
        out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def stream_scrolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places worth saving, with the last kept ones as state between two micro-batches."""
    rows = load(spark, sf_dir, "events").selectExpr("user_id", "get_json_object(props, '$.k') book_id", "event_id seq", "event_id * 37 % 1000 position")
    middle = rows.agg(F.expr("cast(percentile_approx(seq, 0.5) as long)")).first()[0] or 0
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _in_turn(spark, [rows.filter(F.col("seq") <= middle), rows.filter(F.col("seq") > middle)], emit_moved)
    finally:
        spark.conf.set(name, before)


def stream_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled values as session windows of an event-time stream in two halves; two late ticks close all windows."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.expr("timestampdiff(millisecond, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))").alias("ms")).withColumn("at", F.timestamp_millis("ms"))
    middle, end = rows.agg(F.expr("percentile_approx(ms, 0.5)"), F.max("ms")).first()
    ticks = [spark.sql(f"select cast(null as {dict(rows.dtypes)['user_id']}) user_id, cast(-1 as bigint) event_id, ms, timestamp_millis(ms) at from values ({(end or 0) + i * 3_600_000}L) as t(ms)") for i in (1, 2)]
    out = _in_turn(spark, [rows.filter(F.col("ms") <= (middle or 0)), rows.filter(F.col("ms") > (middle or 0)), *ticks], lambda x: settle(x, "user_id", "at", F.col("event_id"), 600_000))
    return out.filter("user_id is not null").select("user_id", "event_id", "ms")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches of `search_catalog` by an index, after an update that renames books and removes others."""
    index = SearchIndex(spark, f"{shared_folder(spark)}/quire-index-{uuid.uuid4().hex}")
    own = _catalog(spark, sf_dir).selectExpr("book_id id", "title", "author", "pos")
    old = own.withColumn("title", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("red widget "), "title")).otherwise(F.col("title"))).select("id", "title", "author")
    gone = own.selectExpr("concat('x', id) id", "title", "author")
    index.update(old.union(gone))
    index.update(own.filter(F.col("pos") % 3 == 0).select("id", "title", "author"), gone.select("id"))
    return index.search(" Red wid ").unionByName(index.search("BRAND 2")).distinct().select(F.col("id").alias("book_id"), "title", "author")


def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next line start at or after several places of each document."""
    own = books(spark, sf_dir).filter("octet_length(text) > 0")
    line_ends = own.select("book_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    starts = line_ends.select("book_id", F.sum(F.octet_length("line") + 1).over(W.partitionBy("book_id").orderBy("n")).cast("long").alias("at"))
    targets = own.select("book_id", F.explode(F.expr("transform(sequence(0, 6), i -> cast(i as bigint) * (octet_length(text) + 1) div 5 + i % 2)")).alias("at")).distinct()
    return asof.next_starts(targets, starts, "book_id", "at", f"{shared_folder(spark)}/quire-asof-{uuid.uuid4().hex}")


def marker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each marker, packed and unpacked."""
    found = headings.positions_of(headings.marker_positions(book_lines(spark, sf_dir)))
    return found.groupBy("book_id", "marker").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line_no")), lambda x: x.cast("string")), " ").alias("positions"))


def convert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat book documents made nested; every third is nested already, every seventh no JSON."""
    form = "named_struct('id', cast(p_partkey as string), 'title', p_name, 'author', p_brand, 'parts', array(named_struct('path', p_type, 'size', cast(p_size as bigint))), 'totalSize', cast(p_size as bigint))"
    documents = load(spark, sf_dir, "part").selectExpr("concat(p_partkey, '.json') filename", f"case when p_partkey % 7 = 0 then '{{broken' when p_partkey % 3 = 0 then to_json(named_struct('book', {form}, 'chapters', array('x'))) else to_json({form}) end json")
    return catalog.convert_documents(documents)


def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings given in part over default ones."""
    rows = load(spark, sf_dir, "events").selectExpr("event_id", "named_struct('fontSize', if(event_id % 2 = 0, cast(event_id % 30 as double), null), 'fontFamily', get_json_object(props, '$.k')) given")
    found = catalog.overlay(F.col("given"), F.struct(F.lit(18.0).alias("fontSize"), F.lit("serif").alias("fontFamily")), ["fontSize", "fontFamily"])
    return rows.select("event_id", found["fontSize"].alias("font_size"), found["fontFamily"].alias("font_family"))


def saved_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.saved(_saves(spark, sf_dir), F.timestamp_millis(F.lit(1893456000000))).select("user_id", "book_id", "seq", F.unix_millis("updated_at").alias("updated_ms"))


def scalar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir).selectExpr("book_id", "text", "cast(coalesce(octet_length(text), 0) as bigint) total", "concat('b', book_id, ' é ', author) title")
    size, done = F.col("total") * 5000, F.col("book_id") % 37 + 1
    names, args = text.download_names(F.col("title")), F.expr("split(concat('--batch=', book_id, ' --memory=1 --batch=', book_id + 1), ' ')")
    return rows.select(
        "book_id", F.sha2(text.one_newline(F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\rend"))), 256).alias("newlines"), text.whole_mib(size).alias("mib"), text.large_file(size, 10).alias("large"),
        text.scan_percent(done, F.lit(37)).alias("scanned"), text.place_label(F.lit("1.5"), F.when(F.col("book_id") % 2 == 0, F.lit("abc")).otherwise("")).alias("place"), text.option(args, "batch", "50").alias("batch"), text.option(args, "size", "512").alias("size"),
        text.duration_label(F.col("book_id") * 7).alias("duration"), text.iso_label(F.timestamp_millis(F.col("book_id") * 86399001)).alias("iso"), names["ascii"].alias("ascii_name"), names["utf8"].alias("utf8_name"),
    )


def reader_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's place from a scroll position, and back."""
    rows = books(spark, sf_dir).selectExpr("book_id", "coalesce(octet_length(text), 0) * 200L total").withColumn("w", reader.restored(F.col("total") / 2, F.col("total")))
    at = reader.progress_byte(F.col("w"), F.col("book_id") % 700, F.lit(700))
    return rows.select("book_id", at.alias("place_byte"), F.round(reader.relative_place(at, F.col("w")), 9).alias("share"))


def fallback_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = books(spark, sf_dir).filter("text is not null").select("book_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return headings.fallback_chapters(own, 20)


def fallback_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.fallback_books(fallback_chapters(spark, sf_dir))


NAMED = (
    chunk_parts, part_offsets, book_index, whole_texts, read_window, reader_windows, progress_label, content_hash, plan_changes, manifest_merge, removed_books, obsolete_assets, pending_batch, duplicate_ids,
    min_lines, slug_names, parse_meta, charset_ratios, detect_encoding, extract_members, ingest_library, ingest_plan, ingest_store, ingest_arrivals, stored_windows, catalog_rows, compat_convert, strip_chapters, search_catalog, catalog_page, progress_valid, progress_mru,
    recent_history, book_progress, stream_progress, title_stats, marker_usage, duplicate_titles, quality_issues, issue_top20, library_summary, heading_scan, heading_hierarchy, heading_score, chapter_spans,
    fallback_chapters, fallback_books, catalog_documents, catalog_written, manifest_books, named_files, config_fallback, ingest_batches, fallback_removed, check_counts, repeated_chapters, scroll_saves,
    settled_searches, saved_progress, scalar_labels, reader_places, progress_lookup, stream_scrolls, stream_searches, search_index, asof_forward, marker_positions, convert_documents, settings_overlay, legacy_charsets,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in NAMED}

PARTS = f"""recursive b as (select doc_id book_id, text, strlen(text)::bigint total, string_split(text, chr(10)) ls from documents where strlen(text) > 0),
l as (select book_id, total, unnest(ls) line, generate_subscripts(ls, 1) i from b),
starts as (select book_id, total, sum(strlen(line) + 1) over (partition by book_id order by i) pos from l),
cut(book_id, total, n, a, e, more) as (select book_id, total, 0, 0::bigint, 0::bigint, true from b
    union all select c.book_id, c.total, c.n + 1, c.e,
        case when c.e + {{size}} < c.total then (select min(s.pos) from starts s where s.book_id = c.book_id and s.pos >= c.e + {{size}})::bigint else c.total end, true
    from cut c where c.e < c.total),
parts as (select book_id, n::int part_no, a start_byte, (e - a)::bigint size from cut where n > 0)"""
P = PARTS.format(size=PART)
SHELL = "'/books/' || book_id || '/part_' || lpad(part_no::varchar, 3, '0') || '.txt'"
UPPER_SQL, PRIMARY_SQL = ("(" + " or ".join(f"contains(title, '{m}')" for m in ms) + ")" for ms in ("卷部册季", "章节回集篇幕话段折品"))
MERGED_SQL = r"len(regexp_extract_all(title, '第\s*[\d〇零一二三四五六七八九十百千]+\s*[章节回集篇幕话段折品]'))"
UPPERS_SQL = r"len(regexp_extract_all(title, '第\s*\S+?\s*[卷部册季]'))"
MARKS_SQL = "len(regexp_extract_all(regexp_replace(title, '[！!？?]+$', ''), '[，。、；]'))"
BARE_SQL = "title"
for _m in "卷部册季":
    BARE_SQL = rf"regexp_replace({BARE_SQL}, '第.*?{_m}\s+', '', 'g')"
SUSPECT_SQL = " or ".join(f"regexp_matches(bare, '{p}')" for p in (r"^[^第\d]*说[^！？。]*。", "^[是这那][^第]*[了着]。", "^[^第]*，[^！？。]{0,10}[。！？]"))
CHAPTERS_SQL = f"ch as (select book_id, row_number() over (partition by book_id order by line_no) chapter, title from ({TITLES}))"
ISSUES_SQL = f"""{CHAPTERS_SQL}, x as (select *, {BARE_SQL} bare, {MERGED_SQL} a, {MARKS_SQL} b, {UPPERS_SQL} c from ch),
iss as (select book_id, 'merged_heading' as type, 'high' severity, chapter, title, a::bigint amount from x where a > 1
    union all select book_id, 'long_title', 'medium', chapter, title, length(title) from x where length(title) > 80
    union all select book_id, 'high_punctuation', 'medium', chapter, title, b from x where b > 3 and not {UPPER_SQL}
    union all select book_id, 'multiple_upper_markers', 'high', chapter, title, c from x where c > 1
    union all select book_id, 'missing_marker', 'medium', chapter, title, 1 from x where not {UPPER_SQL} and not {PRIMARY_SQL} and not regexp_matches(title, '楔子|序章|序言|引子|终章|尾声|尾记|后记|番外|外传|全文')
    union all select book_id, 'suspicious_title', 'medium', chapter, title, 1 from x where {SUSPECT_SQL}
    union all select book_id, 'duplicate_title', 'high', min(chapter), title, count(*) from ch group by book_id, title having count(*) > 1)"""
HEADS = f"h as (select book_id, line_no, regexp_extract(title, '(?i)^(?:【[^】]+】\\s*)?(?:第\\s*)?(?:[IVXLCDM]+|\\d+|[〇零一二三四五六七八九十百千两萬万亿億兆壹贰叁肆伍陆柒捌玖拾佰仟廿卅卌○]+)\\s*(卷|部|册|季|章|节|回|集|篇|幕|话|段|折|品)', 1) marker from ({TITLES}))"
# Blanks and numbers as DuckDB's patterns write them.
SQL_BLANK = r"[ \t\n\x0b\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SQL_NUMBER = r"(?:[IVXLCDM]+|[ivxlcdm]+|[Ⅰ-Ⅻ]+|[ⅰ-ⅻ]+|[0-9]+|[〇零一二三四五六七八九十百千两萬万亿億兆壹贰叁肆伍陆柒捌玖拾佰仟廿卅卌○]+)"


def SQL_TRIM(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def _judged(k: int, u: str) -> str:
    """State of the books' markers after upper marker `u`, the k-th: it moves if frequent and followed by few chapters."""
    after = f"(select count(*) from hit h join cnt c on c.book_id = h.book_id and list_contains(s.prim, c.marker) and h.line_no < c.final where h.book_id = s.book_id and h.marker = '{u}')"
    n = f"(select max(n) from cnt c where c.book_id = s.book_id and c.marker = '{u}')"
    return f"t{k} as (select *, coalesce({n} > 50 and {after} / {n} < 0.3, false) moves from s{k - 1} s), s{k} as (select book_id, case when moves then list_filter(up, lambda x: x <> '{u}') else up end up, case when moves then list_append(prim, '{u}') else prim end prim from t{k})"


_END = "({B}*[:：-]?{B}*)(.*)$"
FORMS_SQL = {  # number, kind, separator and rest by group
    2.4: ("'(?i)^(?:【[^】]+】{B}*)?第{B}*({N}){B}*(' || p || ')" + _END + "'", 1, 2),
    2.25: ("'(?i)^(?:【[^】]+】{B}*)?({N}){B}*(' || p || ')" + _END + "'", 1, 2),
    2.1: ("'(?i)^(?:【[^】]+】{B}*)?(' || p || '){B}*({N})" + _END + "'", 2, 1),
    1.9: (r"'(?i)^(?:【[^】]+】{B}*)?(chapter|chap\.?|ch\.?|episode|ep\.?|act|scene|story){B}*(?:\.|:)?{B}*(?:No\.?|№|#)?{B}*({N})" + _END + "'", 2, 1),
}
FLAT_SCORE_SQL = "case when length(line) <= 18 then 1.2e0 when length(line) <= 34 then 0.8e0 when length(line) <= 48 then 0.2e0 else -1.5e0 end + case when marks = 0 then 0.8e0 when marks = 1 and contains(line, '：') then 0.1e0 else marks * -1.1e0 end"


def _fits(k: int, base: float) -> str:
    form, number, kind = FORMS_SQL[base]
    return f"f{k} as (select *, regexp_extract(line, {form}, {number}) num{k}, {SQL_TRIM(f'regexp_extract(line, {form}, {kind})')} kind{k}, regexp_extract(line, {form}, 3) sep{k}, regexp_extract(line, {form}, 4) rest{k}, len(prim) > 0 and regexp_matches(line, {form}) hit{k} from f{k - 1})"


def _taken(k: int) -> str:
    chinese = "[〇零一二三四五六七八九十百千两萬万亿億兆壹贰叁肆伍陆柒捌玖拾佰仟廿卅卌○]"
    loose = f"not contains(string_split(line, kind{k})[1], '第') and not regexp_matches(num{k}, '(?i)[0-9０-９IVXLCDMⅰ-ⅻ]')"
    return f"hit{k} and not ({loose} and (regexp_matches(num{k}, '^{chinese}+$') or (sep{k} = '' and regexp_matches(left({SQL_TRIM(f'rest{k}')}, 1), '^[0-9A-Za-z_一-鿿]$'))))"


_FIRST = "case " + " ".join(f"when {_taken(k)} then {k}" for k in range(1, 5)) + " end"
_OF = lambda name: "case form " + " ".join(f"when {k} then {name}{k}" for k in range(1, 5)) + " end"
_UP = "'(?i)^第{B}*({N}){B}*(' || u || '){B}*[:：-]?{B}*(.*)$'", "'(?i)^(' || u || '){B}*({N}){B}*[:：-]?{B}*(.*)$'", r"'(?i)^(Book|Part|Section|Volume|Vol\.?){B}*({N}){B}*[:：-]?{B}*(.*)$'"
_GET = lambda i, g: f"regexp_extract(line, {_UP[i]}, {g})"
_TAIL = lambda i: f"case when {SQL_TRIM(_GET(i, 3))} <> '' then ' ' || {SQL_TRIM(_GET(i, 3))} else '' end"
CANDIDATES_SQL = ",\n".join([
    f"lines as ({BOOK_LINES})",
    f"hit as (select book_id, line_no, regexp_extract(t, form, 1) marker from (select *, {SQL_TRIM('line')} t, '(?i)^(?:【[^】]+】{{B}}*)?(?:第{{B}}*)?{{N}}{{B}}*(卷|部|册|季|章|节|回|集|篇|幕|话|段|折|品)' form from lines) where length(t) between 1 and 100 and regexp_matches(t, form))",
    "cnt as (select book_id, marker, count(*) n, max(line_no) final from hit group by all)",
    "s0 as (select book_id, list_filter(['卷', '部', '册', '季'], lambda x: list_contains(list(marker), x)) up, list_filter(['章', '节', '回', '集', '篇', '幕', '话', '段', '折', '品'], lambda x: list_contains(list(marker), x)) prim from cnt group by book_id)",
    *(_judged(k, u) for k, u in enumerate("卷部册季", 1)),
    "own as (select l.book_id, line_no, line, coalesce(up, []) up, coalesce(prim, []) prim, case when len(coalesce(up || prim, [])) > 0 then array_to_string(up || prim, '|') else '卷|部|册|季|章|节|回|集|篇|幕|话|段|折|品' end anyone from lines l left join s4 using (book_id))",
    "parted as (select *, '(?i)(?:【[^】\\r\\n]+】{B}*)?第{B}*{N}{B}*(?:' || anyone || ')' form from own)",
    f"cut as (select book_id, line_no, up, prim, case when regexp_matches(line, form) then list_filter(list_transform(string_split(regexp_replace(line, form, chr(1) || '\\0', 'g'), chr(1)), lambda x: {SQL_TRIM('x')}), lambda x: x <> '') else [line] end cut from parted)",
    f"f0 as (select book_id, line_no, up, prim, array_to_string(prim, '|') p, array_to_string(up, '|') u, len(cut) > 1 composite, {SQL_TRIM('unnest(cut)')} line, generate_subscripts(cut, 1) - 1 part from cut)",
    *(_fits(k, base) for k, base in enumerate(FORMS_SQL, 1)),
    f"picked as (select *, {_FIRST} form from f4)",
    f"parts as (select book_id, line_no, part, up, prim, u, line, {_OF('rest')} rest, {_OF('sep')} sep, composite and {SQL_TRIM(_OF('rest'))} = '' bare, case form when 1 then 2.4e0 when 2 then 2.25e0 when 3 then 2.1e0 when 4 then 1.9e0 end base from picked)",
    f"kept as (select * replace (case when not bare then base end as base), sep || rest after, {SQL_TRIM('sep || rest')} tail, len(regexp_extract_all(regexp_replace(line, '[！!？?]+$', ''), '[，。,。？！、；]')) marks from parts)",
    f"gaps as (select *, length(regexp_extract(after, '^({{B}}+)', 1)) gap, regexp_extract(after, '^{{B}}+([\\p{{P}}\\p{{S}}]*)', 1) lead, left(tail, 1) c, length(tail) n, len(regexp_extract_all(regexp_replace(tail, '[！!？?]+$', ''), '[，。,。？！、；]')) inside from kept)",
    f"""scored as (select *, case when after = '' then base + {FLAT_SCORE_SQL} else base + {FLAT_SCORE_SQL} + case when gap >= 2 then 1e0 when gap = 1 then 0.8e0 else 0e0 end + case when gap > 0 and lead <> '' then 0.2e0 else 0e0 end
      + case when c = '' then 0e0 when regexp_matches(c, '[:：\\-—·,，.。!！?？()（）【】《》「」『』"“”‘’]|{{B}}') then 0.25e0 when contains('上下中末终序外前后番篇卷章', c) then 0.45e0 when regexp_matches(c, '[A-Za-z0-9㐀-䶿一-鿿]') then 0.25e0 else -0.6e0 end
      + case when n > 60 then -1.4e0 when n > 44 then -0.9e0 when n > 32 then -0.4e0 else 0e0 end + case when inside >= 2 and n > 24 then inside * -0.45e0 else 0e0 end end score,
      case when len(up) > 0 and regexp_matches(line, {_UP[0]}) then '第' || {_GET(0, 1)} || {_GET(0, 2)} || {_TAIL(0)} when len(up) > 0 and regexp_matches(line, {_UP[1]}) then {_GET(1, 1)} || {_GET(1, 2)} || {_TAIL(1)}
           when regexp_matches(line, {_UP[2]}) then {_GET(2, 1)} || ' ' || {_GET(2, 2)} || {_TAIL(2)} when regexp_matches(line, '^【(.+?)】$') then line end head,
      case when len(up) > 0 and regexp_matches(line, {_UP[0]}) then {_GET(0, 2)} when len(up) > 0 and regexp_matches(line, {_UP[1]}) then {_GET(1, 1)} when regexp_matches(line, {_UP[2]}) then lower({_GET(2, 1)}) when regexp_matches(line, '^【(.+?)】$') then 'bracket' end mark from gaps)""",
]).replace("{B}", SQL_BLANK).replace("{N}", SQL_NUMBER)
SNAP = """f as (select doc_id book_id, lang, sha256(text) hash from documents),
o as (select book_id, lang, case lang when 'de' then 'old' else hash end hash from f where lang <> 'fr'), m as (select * from o union all select -book_id - 1, lang, hash from f where lang = 'es')"""
SAVES = "s as (select user_id, props->>'$.k' book_id, ts, event_id from events), l as (select user_id, book_id, max(ts) ts, max_by(event_id, (ts, event_id)) seq from s group by all), r as (select *, row_number() over (partition by user_id order by ts desc, seq desc) place from l)"
MRU = f"with {SAVES} select user_id, book_id, seq, place from r where place <= 20"
CELLS = "string_split_regex(lower({}), '[^a-z0-9]+')"
SLUG = "lower(regexp_replace(regexp_replace({}, '[^a-zA-Z0-9一-龥]+', '-', 'g'), '^-+|-+$', '', 'g'))"

SCROLLS = """with recursive s as (select user_id, props->>'$.k' book_id, event_id seq, event_id * 37 % 1000 position, row_number() over (partition by user_id, props->>'$.k' order by event_id) r from events),
w as (select user_id, book_id, seq, position, r, position > 100 kept, case when position > 100 then position else 0 end final from s where r = 1
      union all select s.user_id, s.book_id, s.seq, s.position, s.r, abs(s.position - w.final) > 100, case when abs(s.position - w.final) > 100 then s.position else w.final end from w join s on s.user_id = w.user_id and s.book_id = w.book_id and s.r = w.r + 1)
select user_id, book_id, seq, position from w where kept"""
SETTLED = "with t as (select user_id, event_id, epoch_us(ts) // 1000 ms from events), n as (select *, lead(ms) over (partition by user_id order by ms, event_id) after from t) select user_id, event_id, ms from n where after is null or after - ms >= 600000"
FOUND = f"""with t as (select p_partkey::varchar book_id, p_name title, p_brand author, {CELLS.format('p_name')} a, {CELLS.format('p_brand')} b from part)
select book_id, title, author from t where (len(list_filter(a, lambda x: contains(x, 'red'))) > 0 and len(list_filter(a, lambda x: contains(x, 'wid'))) > 0) or (len(list_filter(b, lambda x: starts_with(x, 'red'))) > 0 and len(list_filter(b, lambda x: starts_with(x, 'wid'))) > 0)
   or (len(list_filter(a, lambda x: contains(x, 'brand'))) > 0 and len(list_filter(a, lambda x: contains(x, '2'))) > 0) or (len(list_filter(b, lambda x: starts_with(x, 'brand'))) > 0 and len(list_filter(b, lambda x: starts_with(x, '2'))) > 0)"""
# Books of archives that are long enough, their parts, and what a library holds of them.
_STORED_SQL = f"""docs as (select doc_id, source, lang, {{text}} text from documents),
whole as (select doc_id, source, regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') text from docs where {{where}}),
books as (select doc_id, {SLUG.format("'b' || doc_id || '-' || source")} book_id, 'b' || doc_id title, source author, text from whole where len(string_split(text, chr(10))) >= 10),
{P.removeprefix('recursive ').replace('select doc_id book_id, text', 'select book_id, text').replace('from documents where', 'from books where')},
counts as (select book_id, count(*) n_parts, sum(size)::bigint total_size, string_agg({SHELL} || ':' || size, ' ' order by part_no) parts, string_agg({SHELL}, ' ' order by part_no) paths from parts group by book_id)"""
_GROWN_SQL = "case when lang = 'de' then text || chr(10) || 'new line' || chr(10) || 'last line' else text end"
_STORED_ROWS_SQL = "select book_id, title, author, '/data/' || book_id || '_chapters.json ' || paths assets, sha256(text) sha256, strlen(text)::bigint n_bytes, n_parts, counts.parts, total_size, 0::bigint unreferenced from books join counts using (book_id)"

ORACLE: dict[str, str] = {
    "chunk_parts": f"with {P} select * from parts",
    "part_offsets": f"with {P} select book_id, part_no, size, (sum(size) over w)::bigint end_byte, (sum(size) over w - size)::bigint start_byte from parts window w as (partition by book_id order by part_no)",
    "book_index": f"with {P} select book_id, string_agg({SHELL} || ':' || size, ' ' order by part_no) parts, sum(size)::bigint total_size from parts group by book_id",
    "whole_texts": "select doc_id book_id, sha256(text) sha256 from documents where strlen(text) > 0",
    "read_window": "select doc_id book_id, (doc_id * 7919 % strlen(text))::bigint start_byte, lower(hex(array_slice(encode(text), doc_id * 7919 % strlen(text) + 1, doc_id * 7919 % strlen(text) + 3000))) bytes from documents where strlen(text) > 0",
    "reader_windows": """with t as (select doc_id book_id, coalesce(strlen(text), 0)::bigint * 200 total from documents), v as (select *, book_id * 7919 % (total + 1) saved from t),
w as (select *, case when saved > 0 then greatest(saved - 100000, 0) else 0 end s1, case when saved > 0 then least(saved + 100000, total) else least(100000, total) end e1 from v),
d as (select *, case when e1 - s1 > 200000 then s1 + 100000 else s1 end s2, least(e1 + 100000, total) e2 from w), g as (select *, case when e2 - s2 > 200000 then s2 + 100000 else s2 end s3, least(e2 + 100000, total) e3 from d)
select book_id, saved, s1::bigint start_1, e1::bigint end_1, greatest(s3 - 100000, 0)::bigint start_2, (case when e3 - s3 > 200000 then e3 - 100000 else e3 end)::bigint end_2 from g""",
    "progress_label": """with t as (select doc_id book_id, text, coalesce(strlen(text), 0)::bigint total from documents), a as (select *, book_id * 131 % (total + 1) p from t),
n as (select *, case when total > 0 then (p * 2000 + total) // (total * 2) else 0 end k, (total * 20 + 1048576) // 2097152 j,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> '')[1] b from a)
select book_id, k // 10 || '.' || k % 10 percent, coalesce(left(b, 20), '') preview, j // 10 || '.' || j % 10 mib from n""",
    "content_hash": "select doc_id book_id, sha256(text) hash from documents",
    "plan_changes": f"with {SNAP} select f.book_id, case when m.hash is null then 'new' when m.hash <> f.hash then 'changed' when f.lang = 'es' then 'missing_index' else 'current' end status from f left join m using (book_id)",
    "manifest_merge": "select doc_id book_id, case when lang in ('fr', 'de') then 'v2-' else '' end || sha256(text) hash, lang from documents",
    "removed_books": f"with {SNAP} select book_id, hash from m where book_id not in (select book_id from f)",
    "obsolete_assets": f"with {PARTS.format(size=PART)}, c as (select book_id, part_no from parts) select book_id, {SHELL} asset from c where (book_id, part_no) not in (select (book_id, part_no) from (with {PARTS.format(size=2 * PART)} select book_id, part_no from parts))",
    "pending_batch": "select doc_id book_id, (row_number() over (order by doc_id) + 49) // 50 batch from documents",
    "duplicate_ids": f"select {SLUG.format("p_name || '-' || p_brand")} book_id, count(*) n, max(p_partkey) last_pos from part group by 1 having count(*) > 1",
    "min_lines": "select doc_id book_id, len(string_split(text, chr(10)))::bigint n_lines from documents where len(string_split(text, chr(10))) >= 10",
    "slug_names": f"select doc_id book_id, {SLUG.format('strip_accents(string_split(text, chr(10))[1])')} slug from documents",
    "parse_meta": f"with t as (select p_partkey, p_name title, case when p_size > 25 then p_brand else '佚名' end author from part) select p_partkey, title, author, {SLUG.format("title || '-' || author")} book_id from t",
    "charset_ratios": """with c as (select doc_id book_id, length(text) n, len(regexp_extract_all(text, chr(65533))) broken, len(regexp_extract_all(text, '[一-龥]')) ideographs,
    len(regexp_extract_all(text, '[a-zA-Z0-9 \\t\\n\\r.,!?;:"''()《》【】　]')) common from documents)
select book_id, n, broken::bigint broken, ideographs::bigint ideographs, common::bigint common, case when n < 100 or broken * 20 > n then false else ideographs * 10 > n or common * 2 > n end plausible from c""",
    "detect_encoding": "select doc_id book_id, case lang when 'de' then 'utf-16le' when 'es' then 'utf-16be' else 'utf-8' end charset, sha256(coalesce(text, '')) sha256 from documents",
    "legacy_charsets": "with t as (select doc_id, ['gb18030', 'big5', 'shift_jis', 'euc-kr'][doc_id % 4 + 1] charset, [" + ", ".join(f"'{x}'" for _, x in LEGACY) + "][doc_id % 4 + 1] words, coalesce(regexp_replace(left(text, 60), '[^\\x00-\\x7f]', '', 'g'), '') start from documents) select doc_id book_id, charset, sha256(start || left(words, doc_id % 30 + 12)) sha256 from t",
    "extract_members": "select '《b' || doc_id || '》作者：' || source || '.rar' filename, sha256(text) sha256, 'book a.txt b_c_.TXT entry_3 a.txt_1' names from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''",
    "ingest_library": f"""with recursive {_STORED_SQL.format(text='text', where='true')} select book_id, title, author, n_parts n_assets from books join counts using (book_id)""",
    "ingest_plan": f"""with recursive {_STORED_SQL.format(text='text', where='true')} select book_id id, title, author, n_parts, total_size from books join counts using (book_id)""",
    "ingest_store": f"""with recursive {_STORED_SQL.format(text=_GROWN_SQL, where="lang <> 'es'")} {_STORED_ROWS_SQL}""",
    "ingest_arrivals": f"""with recursive {_STORED_SQL.format(text=_GROWN_SQL, where='true')} {_STORED_ROWS_SQL}""",
    "stored_windows": f"""with recursive {_STORED_SQL.format(text='text', where='true')}, w as (select book_id, text, strlen(book_id) * 7919 % total_size s from books join counts using (book_id))
select book_id, s::bigint start_byte, lower(hex(array_slice(encode(text), s + 1, s + 3000))) bytes from w where s < strlen(text)""",
    "catalog_rows": "select p_partkey::varchar id, p_name title, p_brand author, 0::int \"totalChapters\" from part",
    "compat_convert": f"with {P} select d.doc_id::varchar id, d.lang title, d.source author, 0::int \"totalChapters\", count(*) n_parts, sum(size)::bigint \"totalSize\", 0::bigint n_chapters from documents d join parts on book_id = doc_id group by all",
    "strip_chapters": "select doc_id::varchar id, 0::bigint n_chapters from documents where lang = 'en' and strlen(text) > 0",
    "search_catalog": FOUND,
    "catalog_page": f"select p_partkey::varchar book_id, p_name title from part where len(list_filter({CELLS.format('p_name')}, lambda x: contains(x, 'bolt'))) > 0 or len(list_filter({CELLS.format('p_brand')}, lambda x: starts_with(x, 'bolt'))) > 0 order by p_partkey limit 100",
    "progress_valid": "select user_id, event_id seq, props->>'$.k' book_id, event_type chapter_id, case when value > 50 then 1893456000000 else epoch_us(ts) // 1000 end updated_ms from events where event_type <> 'error'",
    "progress_mru": MRU,
    "stream_progress": MRU,
    "recent_history": f"with {SAVES} select user_id, book_id, strftime(ts, '%Y/%m/%d %H:%M') as label from r where place <= 5",
    "book_progress": "with s as (select props->>'$.k' book_id, user_id, ts, event_id from events) select p_partkey::varchar book_id, count(distinct user_id) readers, epoch_us(max(ts)) // 1000 last_ms, max_by(user_id, (ts, event_id)) reader, max_by(event_id, (ts, event_id)) seq from part left join s on book_id = p_partkey::varchar group by p_partkey",
    "progress_lookup": "with s as (select user_id, props->>'$.k' book_id, ts, event_id, value from events), a as (select distinct user_id, case when event_id % 2 = 0 then book_id else book_id || '?' end book_id from s), l as (select user_id, book_id, max_by(event_id, (ts, event_id)) seq, round(max_by(value, (ts, event_id)), 6) as value from s group by all) select user_id, book_id, seq, value from a left join l using (user_id, book_id)",
    "title_stats": f"""with {CHAPTERS_SQL}, a as (select book_id, count(*) total, avg(length(title)) avg_len, min(length(title))::int min_len, max(length(title))::int max_len, count(*) filter ({UPPER_SQL}) with_prefix from ch group by book_id)
select *, (with_prefix * 2000 + total) // (total * 2) // 10 || '.' || (with_prefix * 2000 + total) // (total * 2) % 10 || '%' prefix_ratio from a""",
    "marker_usage": f"with {CHAPTERS_SQL}, m as (select unnest(string_split('卷|部|册|季|章|节|回|集|篇|幕|话|段|折|品', '|')) marker) select book_id, marker, count(*) n from ch join m on contains(title, marker) group by all",
    "duplicate_titles": f"with {CHAPTERS_SQL} select book_id, title, count(*) n, min(chapter) first_chapter from ch group by book_id, title having count(*) > 1",
    "quality_issues": f"with {ISSUES_SQL} select * from iss",
    "issue_top20": f"""with {ISSUES_SQL}, p as (select *, row_number() over (partition by book_id order by severity = 'medium', chapter, list_position(['merged_heading', 'duplicate_title', 'long_title', 'high_punctuation', 'multiple_upper_markers', 'reversed_hierarchy', 'missing_marker', 'suspicious_title'], type), title) place, greatest(count(*) over (partition by book_id) - 20, 0) more from iss)
select book_id, type, chapter, title, case when type = 'long_title' then left(title, 60) || '...' else title end shown, place, more from p where place <= 20""",
    "library_summary": f"with {ISSUES_SQL}, t as (select count(distinct book_id) books, count(*) chapters, (select count(*) from iss) issues from ch) select *, round((1 - issues / greatest(chapters, 1)) * 100, 6) quality, case when issues = 0 then 'good' when issues < 10 then 'fair' else 'poor' end verdict from t",
    "heading_scan": f"with {HEADS} select book_id, marker, count(*) n, min(line_no) first_line, max(line_no) last_line from h where marker <> '' group by all",
    "heading_hierarchy": f"with {CANDIDATES_SQL} select book_id, array_to_string(up, '') as upper, array_to_string(prim, '') as primary from s4",
    "heading_score": f"with {CANDIDATES_SQL} select book_id, line_no, part, round(score, 6) score from scored where base is not null",
    "chapter_spans": f"""with {CANDIDATES_SQL}, heads as (select *, {FLAT_SCORE_SQL} flat from scored),
m as (select *, base is null and mark is not null and 1.6e0 + flat >= 1.8e0 is_upper, case when base is not null then score >= 1.8e0 else mark is null and regexp_matches(line, '^(楔子|序章|序言|引子|终章|尾声|尾记|后记|番外|外传)') and 2e0 + flat >= 1.8e0 end is_chapter,
     row_number() over (partition by book_id order by line_no, part) idx, count(*) over (partition by book_id) total from heads),
c as (select *, last_value(case when is_upper then head end ignore nulls) over w up_head, last_value(case when is_upper then mark end ignore nulls) over w up_mark from m
      window w as (partition by book_id order by idx rows between unbounded preceding and 1 preceding))
select book_id, row_number() over o chapter, {SQL_TRIM('case when list_contains(up, up_mark) and not list_contains(prim, up_mark) then up_head || chr(32) || line else line end')} title, idx start_line, coalesce(lead(idx) over o - 1, total) end_line
from c where is_chapter window o as (partition by book_id order by idx)""",
    "fallback_chapters": """with t as (select doc_id book_id, len(string_split(text, chr(10))) n from documents where text is not null), c as (select book_id, n, unnest(range(1, n + 1, 20)) a from t)
select book_id, ((a - 1) // 20 + 1)::bigint chapter, '第' || ((a - 1) // 20 + 1) || '章 第' || a || '-' || least(a + 19, n) || '行' title, a::bigint start_line, least(a + 19, n)::bigint end_line from c""",
    "fallback_books": "select doc_id book_id from documents where text is not null",
    "catalog_documents": "select '2025-01-01T00:00:00.000Z' \"generatedAt\", p_partkey::varchar id, p_name title, p_brand author, p_size \"totalChapters\" from part",
    "catalog_written": "select '2025-01-01T00:00:00.000Z' \"generatedAt\", p_partkey::varchar id, p_name title, p_brand author, 0::int \"totalChapters\" from part",
    "manifest_books": "select p_partkey::varchar book_id, sha256(p_name) hash, p_name title, p_type || '|' || p_brand assets from part",
    "named_files": "select 'b' || p_partkey || '_chapters.json' filename from part where p_partkey % 4 = 0",
    "config_fallback": "select event_id, case when event_id % 3 = 0 then props->>'$.k' else 'none' end k from events",
    "ingest_batches": """with t as (select '《b' || doc_id || '》作者：' || source || '.rar' filename, len(string_split(regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), chr(10))) >= 10 good from documents),
n as (select *, row_number() over (order by filename) pos, count(*) over () total from t), r as (select (pos - 1) // ((total * 2 + 4) // 5) + 1 run, any_value(total) total, any_value((total * 2 + 4) // 5) size, count(*) filter (good) processed, count(*) filter (not coalesce(good, false)) failed from n group by 1)
select run, processed, failed, greatest(total - run * size, 0) remaining, (greatest(total - run * size, 0) + size - 1) // size batches, 0::bigint removed, (sum(processed) over (order by run))::bigint books from r""",
    "fallback_removed": "select doc_id book_id, sha256(text) hash from documents where lang = 'en' or text is null",
    "check_counts": f"""with {ISSUES_SQL}, c as (select unnest(['merged_heading', 'duplicate_title', 'long_title', 'high_punctuation', 'hierarchy', 'missing_marker', 'suspicious_title']) as "check"),
n as (select book_id, case when type in ('multiple_upper_markers', 'reversed_hierarchy') then 'hierarchy' else type end as "check", sum(case when type = 'duplicate_title' then amount - 1 else 1 end)::bigint n from iss group by all)
select b.book_id, c."check", coalesce(n, 0)::bigint n, case when coalesce(n, 0) = 0 then 'none' when n < 5 then 'few' else 'many' end tier from (select distinct book_id from ch) b cross join c left join n on n.book_id = b.book_id and n."check" = c."check\"""",
    "repeated_chapters": f"with {CHAPTERS_SQL}, l as (select book_id, title, count(*) n, list(chapter order by chapter) x from ch group by all having count(*) > 1) select book_id, title, n, array_to_string(x[1:5], ', ') chapters from l",
    "scroll_saves": SCROLLS,
    "settled_searches": SETTLED,
    "stream_searches": SETTLED,
    "stream_scrolls": SCROLLS,
    "search_index": FOUND,
    "asof_forward": """with t as (select doc_id book_id, text from documents where strlen(text) > 0), l as (select book_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from t),
s as (select book_id, (sum(strlen(line) + 1) over (partition by book_id order by n))::bigint s from l), a as (select distinct book_id, (i * (strlen(text) + 1) // 5 + i % 2)::bigint as at from t, range(7) r(i))
select a.book_id, a.at, min(s) as next from a left join s on s.book_id = a.book_id and s >= a.at group by all""",
    "marker_positions": f"with {CANDIDATES_SQL} select book_id, marker, string_agg(line_no::varchar, ' ' order by line_no) positions from hit group by all",
    "convert_documents": """select p_partkey || '.json' filename, '{"book":{"id":"' || p_partkey || '","title":"' || p_name || '","author":"' || p_brand || '","totalChapters":0,"parts":[{"path":"' || p_type || '","size":' || p_size || '}],"totalSize":' || p_size || '},"chapters":[]}' json from part where p_partkey % 7 <> 0 and p_partkey % 3 <> 0""",
    "settings_overlay": "select event_id, case when event_id % 2 = 0 then (event_id % 30)::double else 18 end font_size, coalesce(props->>'$.k', 'serif') font_family from events",
    "saved_progress": "select user_id, props->>'$.k' book_id, event_id seq, 1893456000000 updated_ms from events",
    "scalar_labels": """with t as (select doc_id book_id, text, coalesce(strlen(text), 0)::bigint * 5000 size, 'b' || doc_id || ' é ' || source title, doc_id % 37 + 1 done from documents)
select book_id, sha256(text || chr(10) || 'end') newlines, (size * 2 + 1048576) // 2097152 mib, (size * 2 + 1048576) // 2097152 > 10 large, case when done % 3 = 0 or done = 37 then (done * 200 + 37) // 74 end scanned, case when book_id % 2 = 0 then '1.5% · abc...' else '已读 1.5%' end place,
  (book_id + 1)::varchar batch, '512' size, (book_id * 7 // 60) || 'm ' || (book_id * 7 % 60) || 's' duration, strftime(make_timestamp(book_id * 86399001000), '%Y-%m-%dT%H:%M:%S.%gZ') iso, replace(title, 'é', '_') || '.txt' ascii_name, url_encode(title || '.txt') utf8_name from t""",
    "reader_places": """with t as (select doc_id book_id, coalesce(strlen(text), 0)::bigint * 200 total from documents), w as (select *, case when total > 0 then greatest(total / 2 - 100000, 0)::bigint else 0 end s, case when total > 0 then trunc(least(total / 2 + 100000, total))::bigint else 0 end e from t),
a as (select *, floor(s + (e - s) * (book_id % 700) / 700)::bigint place_byte from w) select book_id, place_byte, case when place_byte > 0 and place_byte >= s and e > s then round((place_byte - s) / (e - s), 9) end share from a""",
}
