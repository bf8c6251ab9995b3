"""The catalogue's shapes, search and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalogue's columns in order.
COLUMNS = ("id", "title", "author", "totalChapters")
PAGE = 50


def summaries(manifest: DataFrame) -> DataFrame:
    """Catalogue records of `manifest` (book_id, title, author, total_chapters, ...), without hash and assets."""
    return manifest.select(F.col("book_id").cast("string").alias("id"), "title", "author", F.col("total_chapters").cast("int").alias("totalChapters"))


def to_rows(records: DataFrame) -> DataFrame:
    """Records as arrays of strings."""
    return records.select(F.array(*[F.col(c).cast("string") for c in COLUMNS]).alias("row"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Arrays back as records."""
    return rows.select(*[F.get("row", F.lit(i)).cast("int" if c == "totalChapters" else "string").alias(c) for i, c in enumerate(COLUMNS)])


DOCUMENT = "generatedAt string, columns array<string>, books array<array<string>>"


def decode_documents(documents: DataFrame) -> DataFrame:
    """Records of catalogue documents (json): each row's fields by the document's own list of columns. Documents that aren't JSON have none."""
    rows = documents.select(F.from_json("json", DOCUMENT).alias("d")).select("d.generatedAt", "d.columns", F.explode("d.books").alias("row"))
    of = lambda c: F.get("row", F.array_position("columns", c).cast("int") - 1)
    return rows.select("generatedAt", *[of(c).cast("int" if c == "totalChapters" else "string").alias(c) for c in COLUMNS])


def write_catalog(records: DataFrame, folder: str, generated_at: Column) -> None:
    """A catalogue as a header (time and columns) and rows of arrays beside it, which all tasks write at once."""
    spark = records.sparkSession
    spark.range(1).select(generated_at.alias("generatedAt"), F.array(*map(F.lit, COLUMNS)).alias("columns")).write.mode("overwrite").json(f"{folder}/header")
    to_rows(records).write.mode("overwrite").json(f"{folder}/rows")


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a written catalogue, by the header's columns, with the time they were generated."""
    head = spark.read.schema("generatedAt string, columns array<string>").json(f"{folder}/header").first()
    rows = spark.read.schema("row array<string>").json(f"{folder}/rows")
    fields = [F.get("row", F.lit(i)).cast("int" if c == "totalChapters" else "string").alias(c) for i, c in enumerate(head.columns)]
    return rows.select(F.lit(head.generatedAt).alias("generatedAt"), *fields)


def manifest_books(documents: DataFrame, fields: str) -> DataFrame:
    """(book_id, fields) of manifests (json) of the form {"books": {id: record}}."""
    rows = documents.select(F.explode(F.from_json("json", f"books map<string, struct<{fields}>>")["books"]).alias("book_id", "x"))
    return rows.select("book_id", "x.*")


def named_files(files: DataFrame, ends: str, never: str, name: str = "filename") -> DataFrame:
    """`files` whose name ends so, but for the one that has the name `never`."""
    return files.filter(F.col(name).endswith(ends) & (F.col(name) != never))


def or_default(json: Column, schema: str, default: Column) -> Column:
    """The record that `json` holds, or the whole default where it isn't JSON."""
    found = F.from_json(json, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(json.isNull() | found["_bad"].isNotNull(), default).otherwise(found.dropFields("_bad"))


def to_compat(flat: DataFrame, *more: str) -> DataFrame:
    """Flat book records (id, title, author, parts, totalSize) as (book, chapters) with no chapters, after the columns `more`."""
    book = F.struct("id", "title", "author", F.lit(0).alias("totalChapters"), "parts", "totalSize")
    return flat.select(*more, book.alias("book"), F.array().cast("array<string>").alias("chapters"))


BOOK = "id string, title string, author string, totalChapters int, parts array<struct<path: string, size: bigint>>, totalSize bigint"


def convert_documents(documents: DataFrame) -> DataFrame:
    """(filename, json) of those `documents` (filename, json) that hold a flat record, in the nested form; nested ones, and what isn't JSON, are left alone."""
    form = f"{BOOK}, book struct<id: string>, chapters array<string>"
    rows = documents.select("filename", F.from_json("json", form).alias("x")).filter("x.id is not null and not (x.book is not null and x.chapters is not null)")
    nested = to_compat(rows.select("filename", "x.*"), "filename")
    return nested.select("filename", F.to_json(F.struct("book", "chapters")).alias("json"))


def strip_chapters(indexes: DataFrame) -> DataFrame:
    """Indexes (book, chapters) that have parts and chapters, without the chapters."""
    rows = indexes.filter("size(book.parts) > 0 and coalesce(size(chapters), -1) <> 0")
    return rows.select(F.col("book").withField("totalChapters", F.lit(0)).alias("book"), F.array().cast("array<string>").alias("chapters"))


def overlay(given: Column, default: Column, fields: list[str]) -> Column:
    """Fields of `given`, and those of `default` where they are null."""
    return F.struct(*[F.coalesce(given[f], default[f]).alias(f) for f in fields])


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")


def search(catalog: DataFrame, query: str, title: str = "title", author: str = "author") -> DataFrame:
    """Rows with all terms of the query inside words of the title, or all at the starts of words of the author; a query without terms finds all."""
    wanted = terms(F.lit(query))
    inside = F.forall(wanted, lambda q: F.exists(terms(F.col(title)), lambda t: F.contains(t, q)))
    starts = F.forall(wanted, lambda q: F.exists(terms(F.col(author)), lambda t: F.startswith(t, q)))
    return catalog.filter(F.coalesce(inside, F.lit(False)) | F.coalesce(starts, F.lit(False)))


def page(catalog: DataFrame, pages: int, order: str, size: int = PAGE) -> DataFrame:
    """The first pages of a catalogue. The limit is the feature."""
    return catalog.orderBy(order).limit(pages * size)
