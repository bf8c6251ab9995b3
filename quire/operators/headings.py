"""Chapter headings: markers of a book, composite lines, candidates, confidence, upper headings, chapter spans.

Every step is columns over lines. A book's own markers make its patterns, which Spark takes from a column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from ..functions.text import BLANK, BLANKS, trimmed

# Numerals, markers, keywords, punctuation and titles of headings, and the score that accepts one.
CHINESE = "〇零一二三四五六七八九十百千两萬万亿億兆壹贰叁肆伍陆柒捌玖拾佰仟廿卅卌○"
ORDINAL = rf"(?:[IVXLCDM]+|[ivxlcdm]+|[Ⅰ-Ⅻ]+|[ⅰ-ⅻ]+|\d+|[{CHINESE}]+)"
PRIMARY = ("章", "节", "回", "集", "篇", "幕", "话", "段", "折", "品")
UPPER = ("卷", "部", "册", "季")
LATIN = r"chapter|chap\.?|ch\.?|episode|ep\.?|act|scene|story"
LATIN_UPPER = r"Book|Part|Section|Volume|Vol\.?"
SPECIAL = "^(楔子|序章|序言|引子|终章|尾声|尾记|后记|番外|外传)(.*)$"
SENTENCE = "[，。,。？！、；]"
DELIMITER = rf"[:：\-—·,，.。!！?？()（）【】《》「」『』\"“”‘’{BLANKS}]"
IDEOGRAPH = "[㐀-䶿一-鿿﨎﨏﨑﨓﨔﨟﨡﨣﨤﨧-﨩]"
SUFFIXES = ("上", "下", "中", "末", "终", "序", "外", "前", "后", "番", "篇", "卷", "章")
ACCEPTED = 1.8
LINE_CHARS, FALLBACK_LINES = 100, 2000
#: An upper marker that more lines carry, and of which a smaller share has chapters after it, is a chapter marker.
FREQUENT, BEFORE = 50, 0.3
#: Books whose markers are broadcast at most.
BROADCAST_BOOKS = 100_000
ANY = "|".join((*UPPER, *PRIMARY))
GAP = f"{BLANK}*"
BRACKET = f"(?:【[^】]+】{GAP})?"


def marked_lines(lines: DataFrame) -> DataFrame:
    """(book_id, line_no, marker, numeral, ordinal) of `lines` (book_id, line_no, line) that start with a number and a marker."""
    form = rf"(?iu)^{BRACKET}(第{GAP})?({ORDINAL}){GAP}({ANY})"
    line = trimmed(F.col("line"))
    rows = lines.select("book_id", "line_no", line.alias("line")).filter(F.length("line").between(1, LINE_CHARS) & F.col("line").rlike(form))
    return rows.select("book_id", "line_no", F.regexp_extract("line", form, 3).alias("marker"), F.regexp_extract("line", form, 2).alias("numeral"), F.regexp_extract("line", form, 0).contains("第").alias("ordinal"))


def marker_counts(lines: DataFrame) -> DataFrame:
    """(book_id, marker, n, first_line, last_line)."""
    return marked_lines(lines).groupBy("book_id", "marker").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


#: Lines of a segment of positions.
SEGMENT = 1 << 16


@F.pandas_udf(BinaryType())
def packed(positions: pd.Series) -> pd.Series:
    """Rising whole numbers as their differences, seven bits a byte, the high bit set but in a number's last byte."""

    def pack(rising) -> bytes:
        out, before = bytearray(), 0
        for x in rising.tolist():
            step, before = x - before, x
            while step > 127:
                out.append(step & 127 | 128)
                step >>= 7
            out.append(step)
        return bytes(out)

    return positions.map(pack)


@F.pandas_udf(ArrayType(LongType()))
def unpacked(data: pd.Series) -> pd.Series:
    def unpack(packed: bytes) -> list[int]:
        out, at, step, shift = [], 0, 0, 0
        for b in packed:
            step |= (b & 127) << shift
            shift += 7
            if b < 128:
                at += step
                out.append(at)
                step = shift = 0
        return out

    return data.map(unpack)


def marker_positions(lines: DataFrame) -> DataFrame:
    """(book_id, marker, segment, n, positions): the lines of each marker in order, packed by `packed` within segments of SEGMENT lines, counted from the segment's start, so a book of any length has bounded rows."""
    rows = marked_lines(lines).withColumn("segment", F.floor(F.col("line_no") / SEGMENT).cast("long"))
    listed = rows.groupBy("book_id", "marker", "segment").agg(F.sort_array(F.collect_list(F.col("line_no") - F.col("segment") * SEGMENT)).alias("at"))
    return listed.select("book_id", "marker", "segment", F.size("at").cast("long").alias("n"), packed("at").alias("positions"))


def positions_of(postings: DataFrame) -> DataFrame:
    """(book_id, marker, line_no) of packed positions."""
    rows = postings.select("book_id", "marker", "segment", F.explode(unpacked("positions")).alias("at"))
    return rows.select("book_id", "marker", (F.col("segment") * SEGMENT + F.col("at")).alias("line_no"))


def hierarchy(lines: DataFrame) -> DataFrame:
    """(book_id, upper, primary): markers of each book of `lines` that has any.

    A frequent upper marker with few chapters after it becomes a chapter marker; markers are judged one after the other,
    and one that has moved counts for those that follow. A later chapter exists if the last one is later, so a book
    needs its markers' last lines (14 at most) and no pairs of lines.
    """
    hits = marked_lines(lines)
    ends = hits.groupBy("book_id", "marker").agg(F.max("line_no").alias("last"), F.count("*").alias("n"))
    by_book = ends.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("marker", "last"))).alias("lasts"), F.map_from_entries(F.collect_list(F.struct("marker", "n"))).alias("counts"))
    later = hits.filter(F.col("marker").isin(*UPPER)).join(by_book.select("book_id", "lasts"), "book_id").select("book_id", F.col("marker").alias("u"), F.explode(F.map_keys(F.map_filter("lasts", lambda k, v: v > F.col("line_no")))).alias("m"))
    pairs = later.groupBy("book_id", "u", "m").agg(F.count("*").alias("n")).groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("u", "m").alias("k"), "n"))).alias("before"))
    rows = by_book.join(pairs, "book_id", "left").withColumn("before", F.coalesce("before", F.expr("cast(map() as map<string, bigint>)")))
    listed = lambda names: F.filter(F.array(*map(F.lit, names)), lambda x: F.map_contains_key("counts", x))
    first = F.struct(listed(UPPER).alias("upper"), listed(PRIMARY).alias("primary"))

    def judge(s: Column, u: Column) -> Column:
        n = F.try_element_at("counts", u)
        after = F.aggregate(s["primary"], F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.try_element_at("before", F.concat(u, m)), F.lit(0)))
        moves = (n > FREQUENT) & (after / n < BEFORE)
        return F.when(moves, F.struct(F.array_remove(s["upper"], u).alias("upper"), F.array_append(s["primary"], u).alias("primary"))).otherwise(s)

    return rows.select("book_id", F.aggregate(listed(UPPER), first, judge).alias("h")).select("book_id", "h.upper", "h.primary")


def has(line: str, form: str) -> Column:
    """Whether a line holds a pattern that a column gives. `rlike` compiles such a pattern for every row, `regexp_instr` keeps the last one."""
    return F.expr(f"regexp_instr({line}, {form}) > 0")


def spread(lines: DataFrame) -> DataFrame:
    """`lines` dealt to all cores by book and line, however few their files and books, those of a book side by side."""
    spark = lines.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.repartition(n, "book_id", "line_no").sortWithinPartitions("book_id")


def segments(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """(book_id, line_no, part, segment, composite, upper, primary): lines cut before every heading inside them."""
    small = markers.limit(BROADCAST_BOOKS + 1).count() <= BROADCAST_BOOKS
    rows = spread(lines).join(F.broadcast(markers), "book_id", "left") if small else lines.join(markers, "book_id", "left").withColumn("upper", F.coalesce("upper", F.array().cast("array<string>"))).withColumn("primary", F.coalesce("primary", F.array().cast("array<string>")))
    own = F.array_join(F.concat("upper", "primary"), "|")
    form = F.concat(F.lit(rf"(?iu)(?:【[^】\r\n]+】{GAP})?第{GAP}{ORDINAL}{GAP}(?:"), F.when(own == "", ANY).otherwise(own), F.lit(")"))
    rows = rows.withColumn("form", form)
    pieces = F.split(F.expr(r"regexp_replace(line, form, '\u0001$0')"), "\u0001", -1)
    cut = F.when(has("line", "form"), F.filter(F.transform(pieces, trimmed), lambda x: x != "")).otherwise(F.array("line"))
    return rows.select("book_id", "line_no", "upper", "primary", cut.alias("cut")).select("book_id", "line_no", "upper", "primary", (F.size("cut") > 1).alias("composite"), F.posexplode("cut").alias("part", "segment"))


def confidence(line: str, base: Column, rest: str | None = None, sep: str | None = None) -> Column:
    """Score of a heading line; `rest` and `sep` name what follows its marker."""
    col = F.col(line)
    n = F.length(col)
    score = base + F.when(n <= 18, 1.2).when(n <= 34, 0.8).when(n <= 48, 0.2).otherwise(-1.5)
    marks = F.regexp_count(F.regexp_replace(col, "[！!？?]+$", ""), F.lit(SENTENCE))
    score = score + F.when(marks == 0, 0.8).when((marks == 1) & col.contains("："), 0.1).otherwise(marks * -1.1)
    if rest is None:
        return score
    after = F.concat(F.col(sep), F.col(rest))
    tail = trimmed(after)
    gap = F.length(F.regexp_extract(after, f"^({BLANK}+)", 1))
    lead = F.regexp_extract(after, "^" + BLANK + r"+([\p{P}\p{S}]*)", 1)
    first = F.substring(tail, 1, 1)
    size = F.length(tail)
    inner = F.regexp_count(F.regexp_replace(tail, "[！!？?]+$", ""), F.lit(SENTENCE))
    terms = (
        F.when(gap >= 2, 1.0).when(gap == 1, 0.8),
        F.when((gap > 0) & (lead != ""), 0.2),
        F.when(first == "", 0.0).when(first.rlike(DELIMITER), 0.25).when(first.isin(*SUFFIXES), 0.45).when(first.rlike("[A-Za-z0-9]"), 0.25).when(first.rlike(IDEOGRAPH), 0.25).otherwise(-0.6),
        F.when(size > 60, -1.4).when(size > 44, -0.9).when(size > 32, -0.4),
        F.when((inner >= 2) & (size > 24), inner * -0.45),
    )
    for term in terms:  # one after the other: the limit is compared with a sum of doubles
        score = score + F.when(F.length(after) > 0, F.coalesce(term, F.lit(0.0))).otherwise(0.0)
    return score


def chapter_candidates(parts: DataFrame) -> DataFrame:
    """`parts` of `segments` with chapter: (rest, sep, base) of the first pattern that a segment fits, null if none does."""
    kinds = F.concat(F.lit("("), F.array_join("primary", "|"), F.lit(")"))
    end = f"({GAP}[:：-]?{GAP})(.*)$"
    forms = (  # number, kind, separator and rest by group
        (2.4, F.concat(F.lit(rf"(?iu)^{BRACKET}第{GAP}({ORDINAL}){GAP}"), kinds, F.lit(end)), 1, 2),
        (2.25, F.concat(F.lit(rf"(?iu)^{BRACKET}({ORDINAL}){GAP}"), kinds, F.lit(end)), 1, 2),
        (2.1, F.concat(F.lit(rf"(?iu)^{BRACKET}"), kinds, F.lit(rf"{GAP}({ORDINAL})" + end)), 2, 1),
        (1.9, F.lit(rf"(?iu)^{BRACKET}({LATIN}){GAP}(?:\.|:)?{GAP}(?:No\.?|№|#)?{GAP}({ORDINAL})" + end), 2, 1),
    )
    rows = parts.withColumn("line", trimmed(F.col("segment")))
    found = F.lit(None).cast("struct<rest: string, sep: string, base: double>")
    for i, (base, form, number, kind) in reversed(list(enumerate(forms))):
        rows = rows.withColumn(f"f{i}", form)
        get = lambda g, i=i: F.expr(f"regexp_extract(line, f{i}, {g})")
        num, mark, sep, rest = get(number), trimmed(get(kind)), get(3), get(4)
        explicit = F.call_function("substring_index", F.col("line"), mark, F.lit(1)).contains("第")
        digits = num.rlike("(?iu)[0-9０-９IVXLCDMⅰ-ⅻ]")
        chinese = num.rlike(f"^[{CHINESE}]+$")
        next_char = F.substring(trimmed(rest), 1, 1)
        passes = (~explicit & ~digits & chinese) | ((sep == "") & next_char.rlike("^[0-9A-Za-z_一-鿿]$") & ~explicit & ~digits)
        fits = (F.size("primary") > 0) & has("line", f"f{i}") & ~passes
        empty = F.col("composite") & (trimmed(rest) == "")
        found = F.when(fits, F.when(~empty, F.struct(rest.alias("rest"), sep.alias("sep"), F.lit(base).alias("base")))).otherwise(found)
    # As rows of an array the patterns are tried once a line; a filter on a plain column would bring them into every use of it.
    return rows.select("*", F.explode(F.array(found)).alias("chapter")).drop(*[f"f{i}" for i in range(len(forms))])


def upper_headings(parts: DataFrame) -> DataFrame:
    """`parts` (line, upper, ...) with heading: (title, marker) of a volume or part heading, null if the line is none."""
    kinds = F.concat(F.lit("("), F.array_join("upper", "|"), F.lit(")"))
    end = f"{GAP}[:：-]?{GAP}(.*)$"
    rows = parts.withColumn("g1", F.concat(F.lit(rf"(?iu)^第{GAP}({ORDINAL}){GAP}"), kinds, F.lit(end))).withColumn("g2", F.concat(F.lit("(?iu)^"), kinds, F.lit(rf"{GAP}({ORDINAL})" + end)))
    latin = rf"(?iu)^({LATIN_UPPER}){GAP}({ORDINAL})" + end
    get = lambda form, g: F.expr(f"regexp_extract(line, {form}, {g})")
    title = lambda head, tail: F.concat_ws(" ", head, F.when(trimmed(tail) != "", trimmed(tail)))
    made = lambda t, m: F.struct(t.alias("title"), m.alias("marker"))
    some = F.size("upper") > 0
    heading = (
        F.when(some & has("line", "g1"), made(title(F.concat(F.lit("第"), get("g1", 1), get("g1", 2)), get("g1", 3)), get("g1", 2)))
        .when(some & has("line", "g2"), made(title(F.concat(get("g2", 1), get("g2", 2)), get("g2", 3)), get("g2", 1)))
        .when(F.col("line").rlike(latin), made(title(F.concat_ws(" ", F.regexp_extract("line", latin, 1), F.regexp_extract("line", latin, 2)), F.regexp_extract("line", latin, 3)), F.lower(F.regexp_extract("line", latin, 1))))
        .when(F.col("line").rlike("^【(.+?)】$"), made(F.col("line"), F.lit("bracket")))
    )
    return rows.withColumn("heading", heading).drop("g1", "g2")


def detect_chapters(lines: DataFrame) -> DataFrame:
    """(book_id, chapter, title, start_line, end_line, line_no) of every chapter of `lines` (book_id, line_no, line).

    start_line and end_line count the segments of a book from 1, line_no is the chapter's line. A title starts with the last
    accepted upper heading before it, if that has one of the book's upper markers. Text before the first heading is in
    no chapter; a book without headings has none. Null lines are no lines.
    """
    rows = upper_headings(chapter_candidates(segments(lines.filter("line is not null"), hierarchy(lines))))
    by = W.partitionBy("book_id").orderBy("line_no", "part")
    rows = rows.withColumn("idx", F.row_number().over(by)).withColumn("rest", F.col("chapter.rest")).withColumn("sep", F.col("chapter.sep"))
    as_chapter = F.col("chapter").isNotNull() & (confidence("line", F.col("chapter.base"), "rest", "sep") >= ACCEPTED)
    as_upper = F.col("chapter").isNull() & F.col("heading").isNotNull()
    as_special = F.col("chapter").isNull() & F.col("heading").isNull() & F.col("line").rlike(SPECIAL) & (confidence("line", F.lit(2.0)) >= ACCEPTED)
    rows = rows.withColumn("current", F.last(F.when(as_upper & (confidence("line", F.lit(1.6)) >= ACCEPTED), F.col("heading")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("total", F.count("*").over(W.partitionBy("book_id")))
    attach = F.array_contains("upper", F.col("current.marker")) & ~F.array_contains("primary", F.col("current.marker"))
    found = rows.filter(as_chapter | as_special).withColumn("title", trimmed(F.concat_ws(" ", F.when(attach, F.col("current.title")), "line")))
    last = W.partitionBy("book_id").orderBy("idx")
    return found.select("book_id", F.row_number().over(last).alias("chapter"), "title", F.col("idx").alias("start_line"), F.coalesce(F.lead("idx").over(last) - 1, F.col("total").cast("int")).alias("end_line"), "line_no")


def fallback_chapters(books: DataFrame, size: int = FALLBACK_LINES) -> DataFrame:
    """(book_id, chapter, title, start_line, end_line): `books` (book_id, n_lines) in chapters of so many lines."""
    rows = books.filter("n_lines > 0").select("book_id", "n_lines", F.explode(F.expr(f"sequence(1L, n_lines, {size}L)")).alias("start_line"))
    rows = rows.withColumn("end_line", F.least(F.col("start_line") + size - 1, F.col("n_lines"))).withColumn("chapter", ((F.col("start_line") - 1) / size + 1).cast("long"))
    return rows.select("book_id", "chapter", F.format_string("第%d章 第%d-%d行", "chapter", "start_line", "end_line").alias("title"), "start_line", "end_line")


def fallback_books(chapters: DataFrame) -> DataFrame:
    """book_id of books whose first chapter (book_id, chapter, title) has a fallback title."""
    return chapters.filter((F.col("chapter") == 1) & F.col("title").rlike(r"^第\d+章 第\d+-\d+行$")).select("book_id")
