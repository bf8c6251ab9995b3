"""Inverted index of a catalogue: the words of titles and authors, and the pieces of letters by which words are found.

Postings (gram, id) name the books of each whole word, t and a title's word or a and an author's, in buckets by word. A
title's word is found by any part of it, so the distinct words stand under all their runs of one to GRAM letters; an author's
under its beginnings of up to PREFIX letters: words (gram, word), in buckets by gram. So a book has as many postings as words,
and pieces are made of the vocabulary alone. The books' texts lie in buckets by id. A search finds the words that hold each
of its terms, reads the buckets of these words, keeps the books that have one for every term, reads the buckets of these, and
applies the exact predicate of `catalog.search`: the index finds candidates, it decides nothing.

An update appends postings to the buckets of its words and rewrites the buckets of its books. Postings of what a book was
called before stay until `compact`; they only make candidates, which the predicate turns down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from .catalog import search, terms

#: Letters of a title's pieces and of an author's beginnings at most, and the numbers of buckets.
GRAM, PREFIX = 3, 8
GRAM_BUCKETS, BOOK_BUCKETS = 64, 16
#: Tasks that write one bucket of books at most.
SPREAD = 8
#: Candidate ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Words of a search that are named in the filter on postings at most; of more, all buckets are read and joined.
NAMED_WORDS = 2_000

BOOKS = "id string, title string, author string"
POSTINGS = "gram string, id string"
WORDS = "gram string, word string"


def pieces(word: Column, sizes: range) -> Column:
    """Runs of so many letters of a word; of one start only for sizes that the word has."""
    run = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*map(run, sizes)))


def beginnings(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.length(word), F.lit(PREFIX))), lambda n: F.substr(word, F.lit(1), n))


def marked(title: Column, author: Column) -> Column:
    """Keys of a book's postings: t and a title's word, a and an author's."""
    own = lambda kind, text: F.coalesce(F.transform(terms(text), lambda w: F.concat(F.lit(kind), w)), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own("t", title), own("a", author)))


def grams(word: Column) -> Column:
    """Keys of a marked word: t and a piece of a title's word, a and a beginning of an author's."""
    kind, bare = F.substr(word, F.lit(1), F.lit(1)), F.substr(word, F.lit(2))
    found = F.when(kind == "t", pieces(bare, range(1, GRAM + 1))).otherwise(beginnings(bare))
    return F.array_distinct(F.transform(found, lambda g: F.concat(kind, g)))


def wanted(query: str, spark: SparkSession) -> list[str]:
    """The distinct terms of a query."""
    return spark.range(1).select(F.array_distinct(terms(F.lit(query)))).first()[0]


def gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def book_bucket(book: Column) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(BOOK_BUCKETS)).cast("int")


class SearchIndex:
    """The index under `root`. Each update is a commit: `segments` are its and its predecessors' postings and words, `books` says which commit wrote each bucket of books last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def books(self, buckets: list[int] | None = None, record: dict | None = None) -> DataFrame:
        """(id, title, author) of all books, or of some buckets."""
        held = (record or self.store.last()).get("books", {})
        places = [f"{self.store.place('books', n)}/bucket={b}" for b, n in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(BOOKS).parquet(*places) if places else self.spark.createDataFrame([], BOOKS)

    def _segments(self, table: str, schema: str, record: dict | None) -> DataFrame:
        places = [self.store.place(table, f"segment={n}") for n in (record or self.store.last()).get("segments", [])]
        return self.spark.read.schema(f"{schema}, segment int, bucket int").option("basePath", f"{self.store.root}/{table}").parquet(*places).drop("segment") if places else self.spark.createDataFrame([], f"{schema}, bucket int")

    def postings(self, record: dict | None = None) -> DataFrame:
        """(gram, id, bucket) of all segments, pruned by filters on the bucket; grams are whole words here."""
        return self._segments("postings", POSTINGS, record)

    def words(self, record: dict | None = None) -> DataFrame:
        """(gram, word, bucket) of all segments, words with their marks; a word may stand in several segments."""
        return self._segments("words", WORDS, record)

    def _post(self, books: DataFrame, number: int) -> None:
        """Write the segment of these books (id, grams): postings, and the pieces of their distinct words."""
        rows = books.select(F.explode("grams").alias("gram"), "id").withColumn("bucket", gram_bucket(F.col("gram")))
        rows = self.store.write(rows.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id"), "postings", f"segment={number}", "bucket")
        words = rows.select(F.col("gram").alias("word")).distinct().select(F.explode(grams(F.col("word"))).alias("gram"), "word").withColumn("bucket", gram_bucket(F.col("gram")))
        self.store.write(words.repartitionByRange("bucket", "gram", "word").sortWithinPartitions("bucket", "gram", "word"), "words", f"segment={number}", "bucket")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Take in `changed` books (id, title, author), new ones too, and drop the `removed` (id); the numbers of buckets touched.

        Of several rows with the same id the greatest counts. Null ids are left out; null titles and authors have no terms.
        """
        last = self.store.last()
        number = last["number"] + 1
        rows = changed.select(F.col("id").cast("string"), "title", "author").filter("id is not null")
        rows = self.store.write(rows.groupBy("id").agg(F.max(F.struct("title", "author")).alias("x")).select("id", "x.title", "x.author", marked(F.col("x.title"), F.col("x.author")).alias("grams")), "changed", number)
        gone = (removed.select(F.col("id").cast("string")).filter("id is not null").distinct() if removed is not None else rows.select("id").limit(0))
        gone = self.store.write(gone.join(rows, "id", "left_anti"), "removed", number)
        touched = [r[0] for r in rows.select("id").union(gone).select(book_bucket(F.col("id"))).distinct().collect()]  # BOOK_BUCKETS at most
        kept = self.books(touched, last).join(rows.select("id").union(gone), "id", "left_anti")
        following = kept.unionByName(rows.drop("grams")).withColumn("bucket", book_bucket(F.col("id")))
        self.store.write(following.repartition("bucket", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SPREAD))).sortWithinPartitions("bucket", "id"), "books", number, "bucket")
        self._post(rows, number)
        written = [int(x.partition("=")[2]) for x in self.store.children(f"books/{number}") if x.startswith("bucket=")]
        books = {b: n for b, n in last.get("books", {}).items() if int(b) not in touched} | {str(b): number for b in written}
        buckets = sum(x.startswith("bucket=") for x in self.store.children(f"postings/segment={number}"))
        self.store.commit(number, {"segments": [*last.get("segments", []), *[number] * bool(buckets)], "books": books})
        self.store.remove([f"changed/{number}", f"removed/{number}"])
        return {"books": len(touched), "postings": buckets}

    def matching(self, kind: str, asked: list[str], record: dict | None = None) -> DataFrame:
        """(term, gram) of the marked words of titles (kind t) or authors (a) that hold each asked term, or begin with it."""
        keys = [(i, kind + q[: GRAM if kind == "t" else PREFIX], q) for i, q in enumerate(asked)]
        keys = self.spark.createDataFrame(keys, "term int, gram string, q string").withColumn("bucket", gram_bucket(F.col("gram")))
        named = keys.select("gram", "bucket").collect() if len(asked) <= NAMED_WORDS else []
        rows = self.words(record)
        if named:
            rows = rows.filter(F.col("bucket").isin(sorted({r.bucket for r in named})) & F.col("gram").isin([r.gram for r in named]))
        bare = F.substr("word", F.lit(2))
        holds = F.contains(bare, F.col("q")) if kind == "t" else F.startswith(bare, F.col("q"))
        return rows.drop("bucket").join(F.broadcast(keys.drop("bucket")), "gram").filter(holds).select("term", F.col("word").alias("gram")).distinct()

    def candidates(self, query: str) -> DataFrame:
        """(id) of the books that have a word for each of a query's terms in their titles, or one for each in their authors."""
        record, asked = self.store.last(), wanted(query, self.spark)
        if not asked:
            return self.books(record=record).select("id")
        found = self.spark.createDataFrame([], "id string")
        for kind in "ta":
            words = self.matching(kind, asked, record)
            few = words.withColumn("bucket", gram_bucket(F.col("gram"))).limit(NAMED_WORDS + 1).collect()
            rows = self.postings(record)
            if len(few) <= NAMED_WORDS:
                if len({r.term for r in few}) < len(asked):
                    continue
                rows = rows.filter(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("gram").isin(sorted({r.gram for r in few})))
                words = F.broadcast(self.spark.createDataFrame([(r.term, r.gram) for r in few], "term int, gram string"))
            if len(asked) > 1:
                rows = rows.join(words, "gram").select("id", "term").repartition("id").distinct().groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked))
            elif len(few) > NAMED_WORDS:
                rows = rows.join(words, "gram", "left_semi")
            found = found.union(rows.select("id"))
        return found.distinct()

    def search(self, query: str) -> DataFrame:
        """(id, title, author) of the books that `catalog.search` finds."""
        record, ids = self.store.last(), self.candidates(query)
        n, buckets = ids.agg(F.count("*"), F.collect_set(book_bucket(F.col("id")))).first()  # BOOK_BUCKETS at most
        few = F.broadcast(ids) if n <= BROADCAST_IDS else ids
        return search(self.books(buckets, record).join(few, "id", "left_semi"), query)

    def compact(self) -> None:
        """Write all postings that hold as one segment, and drop what no record names."""
        last = self.store.last()
        number = last["number"] + 1
        self._post(self.books(record=last).select("id", marked(F.col("title"), F.col("author")).alias("grams")), number)
        self.store.commit(number, {"segments": [number], "books": last.get("books", {})})
        self.store.forget(1)
        live = {str(n) for n in last.get("books", {}).values()}
        self.store.remove([f"{table}/{n}" for table in ("postings", "words") for n in self.store.children(table) if n != f"segment={number}"] + [f"books/{n}" for n in self.store.children("books") if n not in live])
