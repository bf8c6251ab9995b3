"""Quality report over chapter titles: issues, their order, statistics, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .headings import PRIMARY, UPPER

# Limits, patterns and words of the checks, and the order in which checks and severities are listed.
LONG, MARKS, SHOWN, CUT = 80, 3, 20, 60
GAP = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
MERGED = rf"第{GAP}*[\p{{Nd}}〇零一二三四五六七八九十百千]+{GAP}*[{''.join(PRIMARY)}]"
UPPERS = rf"第{GAP}*[^{GAP[1:-1]}]+?{GAP}*[{''.join(UPPER)}]"
SUSPICIOUS = ("^[^第\\p{Nd}]*说[^！？。]*。", "^[是这那][^第]*[了着]。", "^[^第]*，[^！？。]{0,10}[。！？]")
SPECIAL = ("楔子", "序章", "序言", "引子", "终章", "尾声", "尾记", "后记", "番外", "外传", "全文")
CHECKS = ("merged_heading", "duplicate_title", "long_title", "high_punctuation", "multiple_upper_markers", "reversed_hierarchy", "missing_marker", "suspicious_title")
REPORTED = ("merged_heading", "duplicate_title", "long_title", "high_punctuation", "hierarchy", "missing_marker", "suspicious_title")
HIGH = ("merged_heading", "duplicate_title", "multiple_upper_markers", "reversed_hierarchy")


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def issues(chapters: DataFrame) -> DataFrame:
    """(book_id, type, severity, chapter, title, amount) of `chapters` (book_id, chapter from 1, title). Null titles: none.

    `amount` is what the check counted. A repeated title is one issue, at its first chapter. A reversed hierarchy can't occur: both its
    markers are looked for from the first ordinal sign on, so neither match starts later.
    """
    t = F.col("title")
    bare = reduce(lambda x, m: F.regexp_replace(x, rf"第.*?{m}{GAP}+", ""), UPPER, t)
    marks = F.regexp_count(F.regexp_replace(t, "[！!？?]+$", ""), F.lit("[，。、；]"))
    merged, uppers = F.regexp_count(t, F.lit(MERGED)), F.regexp_count(t, F.lit(UPPERS))
    suspicious = reduce(lambda a, b: a | b, [bare.rlike(p) for p in SUSPICIOUS])
    found = [F.when(hit, F.struct(F.lit(kind).alias("type"), amount.cast("long").alias("amount"))) for kind, hit, amount in (
        ("merged_heading", merged > 1, merged), ("long_title", F.length(t) > LONG, F.length(t)), ("high_punctuation", ~holds_any(t, UPPER) & (marks > MARKS), marks),
        ("multiple_upper_markers", uppers > 1, uppers), ("missing_marker", ~holds_any(t, SPECIAL) & ~holds_any(t, (*UPPER, *PRIMARY)), F.lit(1)), ("suspicious_title", suspicious, F.lit(1)),
    )]
    rows = chapters.filter("title is not null").select("book_id", "chapter", "title", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("book_id", "x.type", "chapter", "title", "x.amount")
    twice = duplicate_titles(chapters).select("book_id", F.lit("duplicate_title").alias("type"), F.col("first_chapter").alias("chapter"), "title", F.col("n").alias("amount"))
    return rows.unionByName(twice).select("book_id", "type", F.when(F.col("type").isin(*HIGH), "high").otherwise("medium").alias("severity"), "chapter", "title", "amount")


def duplicate_titles(chapters: DataFrame) -> DataFrame:
    """(book_id, title, n, first_chapter) of titles that a book has twice or more."""
    return chapters.filter("title is not null").groupBy("book_id", "title").agg(F.count("*").alias("n"), F.min("chapter").alias("first_chapter")).filter("n > 1")


def repeated_chapters(chapters: DataFrame, most: int = 5) -> DataFrame:
    """(book_id, title, n, chapters): repeated titles with their first `most` chapters, which are all that is listed of them."""
    by = W.partitionBy("book_id", "title").orderBy("chapter")
    rows = chapters.filter("title is not null").select("book_id", "title", "chapter", F.row_number().over(by).alias("r"), F.count("*").over(W.partitionBy("book_id", "title")).alias("n"))
    return rows.filter(f"n > 1 and r <= {most}").groupBy("book_id", "title").agg(F.max("n").alias("n"), F.array_join(F.sort_array(F.collect_list("chapter")), ", ").alias("chapters"))


def check_counts(chapters: DataFrame) -> DataFrame:
    """(book_id, check, n, tier) of every book and check: what each found, and none, few (under 5) or many. A title found n times counts n - 1."""
    n = F.when(F.col("type") == "duplicate_title", F.col("amount") - 1).otherwise(F.lit(1))
    check = F.when(F.col("type").isin("multiple_upper_markers", "reversed_hierarchy"), "hierarchy").otherwise(F.col("type"))
    found = issues(chapters).groupBy("book_id", check.alias("check")).agg(F.sum(n).alias("n"))
    every = chapters.select("book_id").distinct().select("book_id", F.explode(F.array(*map(F.lit, REPORTED))).alias("check"))
    rows = every.join(found, ["book_id", "check"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("tier", F.when(F.col("n") == 0, "none").when(F.col("n") < 5, "few").otherwise("many"))


def first_issues(found: DataFrame, most: int = SHOWN) -> DataFrame:
    """A book's first `most` issues by severity, chapter and check, with place, how many more there are, and the title as shown: of a long one its first CUT characters."""
    order = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("type"))
    by = W.partitionBy("book_id").orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "chapter", order, "title")
    rows = found.withColumn("place", F.row_number().over(by)).withColumn("more", F.greatest(F.count("*").over(W.partitionBy("book_id")) - most, F.lit(0)))
    rows = rows.withColumn("shown", F.when(F.col("type") == "long_title", F.concat(F.substring("title", 1, CUT), F.lit("..."))).otherwise(F.col("title")))
    return rows.filter(F.col("place") <= most)


def title_stats(chapters: DataFrame) -> DataFrame:
    """(book_id, total, avg_len, min_len, max_len, with_prefix, prefix_ratio) of every book; a book whose titles are all null counts none."""
    n = F.length("title")
    rows = chapters.groupBy("book_id").agg(F.count("title").alias("total"), F.avg(n).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count_if(holds_any(F.col("title"), UPPER)).alias("with_prefix"))
    tenth = F.floor((F.col("with_prefix") * 2000 + F.col("total")) / (F.col("total") * 2)).cast("long")
    return rows.withColumn("prefix_ratio", F.when(F.col("total") > 0, F.concat(F.floor(tenth / 10).cast("string"), F.lit("."), (tenth % 10).cast("string"), F.lit("%"))).otherwise("0.0%"))


def marker_usage(chapters: DataFrame) -> DataFrame:
    """(book_id, marker, n): titles that hold each marker."""
    rows = chapters.select("book_id", F.explode(F.filter(F.array(*map(F.lit, (*UPPER, *PRIMARY))), lambda m: F.contains("title", m))).alias("marker"))
    return rows.groupBy("book_id", "marker").agg(F.count("*").alias("n"))


def library_summary(chapters: DataFrame, found: DataFrame) -> DataFrame:
    """One row: books, chapters, issues, quality (percent), verdict."""
    totals = chapters.agg(F.count_distinct("book_id").alias("books"), F.count("title").alias("chapters"))
    out = totals.crossJoin(found.agg(F.count("*").alias("issues")))  # one row each
    quality = (1 - F.col("issues") / F.greatest("chapters", F.lit(1))) * 100
    return out.withColumn("quality", quality).withColumn("verdict", F.when(F.col("issues") == 0, "good").when(F.col("issues") < 10, "fair").otherwise("poor"))
