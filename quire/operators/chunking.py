"""Line-aligned parts of texts, their index, and texts put together from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: least bytes of a part but the last, 25 MiB less 1 KiB.
PART_BYTES = 26_213_376


def with_cuts(books: DataFrame, part_bytes: int, legacy_sentinel: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """`books` (book_id, text) that have text, with the ends of their parts: each at the first line start so many bytes on."""
    end = "" if legacy_sentinel else "least"
    cut = f"{end}(a.pos + w{', total' if end else ''})"
    step = f"""aggregate(sizes, named_struct('pos', 0L, 'start', 0L, 'cuts', cast(array() as array<bigint>)), (a, w) ->
        if(a.pos + w >= a.start + {part_bytes} and a.start + {part_bytes} < total,
           named_struct('pos', a.pos + w, 'start', {cut}, 'cuts', array_append(a.cuts, {cut})),
           named_struct('pos', a.pos + w, 'start', a.start, 'cuts', a.cuts)))"""
    rows = books.filter("octet_length(text) > 0").selectExpr("book_id", *carry, "text", "cast(octet_length(text) as bigint) total", r"transform(split(text, '\n', -1), y -> cast(octet_length(y) + 1 as bigint)) sizes")
    return rows.withColumn("z", F.expr(step)).selectExpr("book_id", *carry, "text", "total", "if(z.start < total, array_append(z.cuts, total), z.cuts) cuts")


def chunk_parts(books: DataFrame, part_bytes: int = PART_BYTES, legacy_sentinel: bool = True, content: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(book_id, part_no from 1, start_byte, size[, content], columns to carry) for every part of `books` (book_id, text).

    Cuts round up to line starts, so parts may exceed `part_bytes`. With `legacy_sentinel` the size of a last part that
    a cut ends is one more than its bytes. Null or empty text: no parts. No shuffle: each text is cut where it lies.
    """
    cuts = with_cuts(books, part_bytes, legacy_sentinel, carry)
    ends = "transform(cuts, (e, i) -> named_struct('part_no', i + 1, 'start_byte', if(i = 0, 0L, cuts[i - 1]), 'size', e - if(i = 0, 0L, cuts[i - 1])))"
    rows = cuts.select("book_id", *carry, *["text"] * content, F.explode(F.expr(ends)).alias("p"))
    data = [F.expr("substring(cast(text as binary), cast(p.start_byte + 1 as int), cast(p.size as int))").alias("content")] * content
    return rows.select("book_id", "p.part_no", "p.start_byte", "p.size", *data, *carry)


def part_offsets(parts: DataFrame) -> DataFrame:
    """`parts` (book_id, part_no, size) with start_byte and end_byte, the running sums of sizes."""
    by = W.partitionBy("book_id").orderBy("part_no").rowsBetween(W.unboundedPreceding, 0)
    return parts.withColumn("end_byte", F.sum("size").over(by)).withColumn("start_byte", F.col("end_byte") - F.col("size"))


def part_path(book_id: str = "book_id", part_no: str = "part_no") -> F.Column:
    return F.format_string("/books/%s/part_%03d.txt", F.col(book_id).cast("string"), F.col(part_no))


def book_index(parts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(book_id, parts of (path, size), total_size, columns to carry) from (book_id, part_no, size) and these, which all parts of a book share."""
    rows = parts.withColumn("path", part_path())
    listed = F.sort_array(F.collect_list(F.struct("part_no", "path", "size")))
    return rows.groupBy("book_id").agg(F.transform(listed, lambda x: F.struct(x["path"].alias("path"), x["size"].alias("size"))).alias("parts"), F.sum("size").alias("total_size"), *[F.any_value(c).alias(c) for c in carry])


def joined(pieces: F.Column) -> F.Column:
    """An array of bytes as one, in time that follows the bytes: a cast to string leaves them as they are."""
    return F.array_join(F.transform(pieces, lambda x: x.cast("string")), "").cast("binary")


def whole_texts(parts: DataFrame) -> DataFrame:
    """(book_id, content): parts (book_id, part_no, content) in order, one after the other."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("part_no", "content"))), lambda x: x["content"])
    return parts.groupBy("book_id").agg(joined(listed).alias("content"))


def long_enough(books: DataFrame, least: int = 10) -> DataFrame:
    """Books with at least so many lines."""
    return books.filter(F.size(F.split("text", "\n", -1)) >= least)
