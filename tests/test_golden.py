"""Known results, traps and properties of the library's operators."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import encoding, text
from quire.operators import catalog, chunking, headings, manifest, progress, quality, reader
from quire.sources import library
from quire.streaming.progress import keep_most_recent


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.mark.parametrize(("body", "size", "sizes"), [("aaaa\nbbbb\ncccc", 6, [10, 4]), ("aaaa\nbbbbbbbbbb", 6, [16]), ("aaaa\nbb\ncccc\n", 5, [5, 8]), ("章\n节", 2, [4, 4])])
def test_parts(spark, body, size, sizes):
    books = spark.createDataFrame([("b", body)], "book_id string, text string")
    assert [r.size for r in chunking.chunk_parts(books, size).orderBy("part_no").collect()] == sizes
    exact = chunking.chunk_parts(books, size, legacy_sentinel=False, content=True)
    assert sum(r.size for r in exact.collect()) == len(body.encode())
    assert chunking.whole_texts(exact).first().content == body.encode()


def test_parts_of_nothing(spark):
    books = spark.createDataFrame([("a", None), ("b", "")], "book_id string, text string")
    assert chunking.chunk_parts(books).count() == 0


def test_windows_read_back_the_text(spark):
    r = random.Random(3)
    body = "\n".join("é" * r.randrange(9) + "x" * r.randrange(9) for _ in range(60))
    books = spark.createDataFrame([("b", body)], "book_id string, text string")
    parts = chunking.chunk_parts(books, 37, content=True)
    n = len(body.encode())
    windows = spark.createDataFrame([(i, "b", i * 50, 50) for i in range(n // 50 + 1)] + [(99, "b", n, 5), (98, "b", -1, 5), (97, "b", 0, 0), (96, None, 0, 5)], "window_id long, book_id string, start_byte long, length long")
    found = reader.read_windows(windows, parts).orderBy("window_id").collect()
    assert b"".join(bytes(x.content) for x in found) == body.encode()


@pytest.mark.parametrize(("total", "first", "move", "last"), [(1_000_000, (0, 300_000), "down", (100_000, 400_000)), (1_000_000, (0, 200_000), "down", (0, 300_000)), (1_000_000, (150_000, 450_000), "up", (50_000, 350_000)), (1_000_000, (50_000, 350_000), "up", (0, 250_000))])
def test_window_moves(spark, total, first, move, last):
    w = F.struct(F.lit(first[0]).cast("long").alias("s"), F.lit(first[1]).cast("long").alias("e"))
    out = spark.range(1).select(reader.moved(w, F.array(F.lit(move)), F.lit(total).cast("long")).alias("w")).first().w
    assert (out.s, out.e) == last


def test_restored_window(spark):
    out = spark.createDataFrame([(0,), (250_000,), (None,)], "saved long").select(reader.restored(F.col("saved"), F.lit(1_000_000)).alias("w")).collect()
    assert [(r.w.s, r.w.e) for r in out] == [(0, 100_000), (150_000, 350_000), (0, 100_000)]


def test_names(spark):
    df = spark.createDataFrame([("《从零开始》作者：雷云风暴.rar",), ("Foo Bar.RAR",), ("Café!!.rar",), ("かな.rar",)], "f string").select(text.book_name(F.col("f")).alias("n"))
    out = df.select("n.*", text.slug(F.concat_ws("-", "n.title", "n.author")).alias("id")).collect()
    assert [tuple(r) for r in out] == [("从零开始", "雷云风暴", "从零开始-雷云风暴"), ("Foo Bar", "佚名", "foo-bar-佚名"), ("Café!!", "佚名", "cafe-佚名"), ("かな", "佚名", "佚名")]


def spans(spark, *lines):
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(lines)], "book_id string, line_no long, line string")
    return rows(headings.detect_chapters(df).orderBy("chapter"), "title", "start_line", "end_line")


def test_chapters(spark):
    assert spans(spark, "序", "第一卷 少年", "第一章 风起", "正文", "第二章") == [("第一卷 少年 第一章 风起", 3, 4), ("第一卷 少年 第二章", 5, 5)]
    assert spans(spark, "Chapter 1 Start", "text") == []
    assert [t for t, _, _ in spans(spark, "Book 2", "第一章 甲")] == ["第一章 甲"]
    assert [t for t, _, _ in spans(spark, "第一章 甲", "Chapter 2 B", "楔子")] == ["第一章 甲", "Chapter 2 B", "楔子"]
    assert spans(spark, "前文 第一章 甲 第二章 乙") == []  # no line starts with a marker, so the book has none
    assert spans(spark, "第九章 始", "前文 第一章 甲 第二章 乙") == [("第九章 始", 1, 2), ("第一章 甲", 3, 3), ("第二章 乙", 4, 4)]


@pytest.mark.parametrize(("line", "base", "rest", "sep", "score"), [("第一章 风起", 2.4, "风起", " ", 5.45), ("第二章", 2.4, "", "", 4.4), ("第一卷 少年", 1.6, None, None, 3.6), ("第一章他走进了屋子，看见桌上放着一封信，信封上写着他的名字，他犹豫了一下，还是拆开了。", 2.4, "他走进了屋子，看见桌上放着一封信，信封上写着他的名字，他犹豫了一下，还是拆开了。", "", -5.3), ("第一章 " + "风" * 13 + "，" + "起" * 12 + "！！", 2.4, "风" * 13 + "，" + "起" * 12 + "！！", " ", 3.15), ("第一章 " + "风" * 13 + "，" + "起" * 12 + "！！！", 2.4, "风" * 13 + "，" + "起" * 12 + "！！！", " ", 3.15), ("楔子", 2.0, None, None, 4.0)])
def test_confidence(spark, line, base, rest, sep, score):
    df = spark.createDataFrame([(line, rest, sep)], "line string, rest string, sep string")
    names = () if rest is None else ("rest", "sep")
    assert round(df.select(headings.confidence("line", F.lit(base), *names)).first()[0], 6) == score


def test_frequent_upper_marker_becomes_primary(spark):
    lines = [("a", i, f"第{i + 1}卷") for i in range(60)] + [("b", 0, "第1章"), *[("b", i, f"第{i}卷") for i in range(1, 40)]]
    out = headings.hierarchy(spark.createDataFrame(lines, "book_id string, line_no long, line string")).orderBy("book_id")
    assert rows(out, "upper", "primary") == [([], ["卷"]), (["卷"], ["章"])]


def test_fallback_chapters(spark):
    out = headings.fallback_chapters(spark.createDataFrame([("b", 76_286)], "book_id string, n_lines long"))
    assert out.count() == 39
    assert out.orderBy(F.desc("chapter")).first().title == "第39章 第76001-76286行"
    assert rows(headings.fallback_books(out), "book_id") == [("b",)]


def test_wide_blanks(spark):
    df = spark.createDataFrame([("b", 1, "第\u3000二章 乙"), ("b", 2, "\u3000第三\u00a0章\u3000丙"), ("b", 3, "正文"), ("b", 4, "第四章 甲\u3000第五章 乙")], "book_id string, line_no long, line string")
    assert [r.title for r in headings.detect_chapters(df).orderBy("chapter").collect()] == ["第\u3000二章 乙", "第三\u00a0章\u3000丙", "第四章 甲", "第五章 乙"]
    merged = spark.createDataFrame([("b", 1, "第\u3000一\u3000章 第二章")], "book_id string, chapter long, title string")
    assert rows(quality.issues(merged), "type", "amount") == [("merged_heading", 2)]


def test_quality(spark):
    titles = ["第二章 第三章 乙", "第一卷 第二部 丙", "a，b，c，d，e", "第1章 第2卷", None]
    found = rows(quality.issues(spark.createDataFrame([("b", i, t) for i, t in enumerate(titles, 1)], "book_id string, chapter long, title string")).orderBy("chapter", "type"), "chapter", "type", "amount")
    assert found == [(1, "merged_heading", 2), (2, "multiple_upper_markers", 2), (3, "high_punctuation", 4), (3, "missing_marker", 1)]
    same = spark.createDataFrame([("b", i, "第1章") for i in (1, 2, 3)], "book_id string, chapter long, title string")
    assert rows(quality.issues(same), "type", "chapter", "amount") == [("duplicate_title", 1, 3)]
    none = spark.createDataFrame([], "book_id string, chapter long, title string")
    assert quality.title_stats(none).count() == 0 and quality.library_summary(none, quality.issues(none)).first().verdict == "good"


def test_most_recent(spark):
    saves = [("u", x, i, i) for i, x in enumerate("ABA")] + [("v", f"b{i}", i, i) for i in range(21)]
    out = progress.most_recent(spark.createDataFrame(saves, "user_id string, book_id string, updated_at long, seq long"))
    assert rows(out.filter("user_id = 'u'").orderBy("place"), "book_id") == [("A",), ("B",)]
    kept = {r.book_id for r in out.filter("user_id = 'v'").collect()}
    assert len(kept) == 20 and "b0" not in kept


def test_manifest(spark):
    old = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "1")], "book_id string, hash string")
    files = spark.createDataFrame([("A", "2"), ("B", "1"), ("D", "1")], "book_id string, hash string")
    plan = manifest.plan_changes(files, old, spark.createDataFrame([("A",)], "book_id string"))
    assert sorted(rows(plan, "book_id", "status")) == [("A", "changed"), ("B", "missing_index"), ("D", "new")]
    following = manifest.merge_manifest(old, files.filter("book_id <> 'B'"), files)
    assert sorted(rows(following, "book_id", "hash")) == [("A", "2"), ("B", "1"), ("D", "1")]
    assert rows(manifest.removed_books(old, following), "book_id") == [("C",)]
    assert manifest.merge_manifest(following, files.limit(0), files).exceptAll(following).count() == 0


def test_numbering_is_global(spark):
    df = spark.range(1000).selectExpr("id * 3 x")
    assert rows(manifest.numbered(df, "x").orderBy("x"), "pos") == [(i,) for i in range(1, 1001)]
    assert manifest.numbered(df.limit(0), "x").count() == 0


def test_charsets(spark):
    body = "汉字" * 60
    cases = [body.encode("utf-8-sig"), body.encode("utf-16"), b"\xfe\xff" + body.encode("utf-16-be"), body.encode("gb18030"), body.encode(), b"", None]
    out = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c binary").select("i", encoding.charset(F.col("c")).alias("s"), "c").withColumn("t", encoding.decoded("c", "s")).orderBy("i").collect()
    assert [r.s for r in out] == ["utf-8", "utf-16le", "utf-16be", "gb18030", "utf-8", "utf-8", None]
    assert [r.t for r in out] == [body] * 5 + ["", None]
    named = spark.createDataFrame([(x,) for x in ("GB2312", "UTF-16", "Shift_JIS", "UTF8", "windows-1252")], "n string").select(encoding.standard_charset(F.col("n")).alias("s"))
    assert rows(named, "s") == [("gb18030",), ("utf-16le",), ("shift_jis",), ("utf-8",), ("windows-1252",)]


SAMPLES = {
    "gb18030": ["天色渐渐暗了下来，他站在窗前望着远处的山峦。", "春眠不觉晓，处处闻啼鸟。", "第一章 风起云涌", "“你来了？”老人抬起头。"],
    "big5": ["天色漸漸暗了下來，他站在窗前望著遠處的山巒。", "春眠不覺曉，處處聞啼鳥。", "第一章 風起雲湧", "「你來了？」老人抬起頭。"],
    "shift_jis": ["空がだんだん暗くなり、彼は窓の前に立った。", "吾輩は猫である。名前はまだ無い。", "第一章 風の始まり", "「来たのか」と老人は笑った。"],
    "euc-kr": ["하늘이 점점 어두워지자 그는 창가에 서서 먼 산을 바라보았다.", "나라의 말이 중국과 달라 문자와 서로 통하지 아니하니", "제일장 바람이 분다", "노인이 고개를 들고 물었다."],
}


def test_unmarked_legacy_texts():
    """All parts of six characters and more of the samples, and bytes that are no text of these languages."""
    right = [(encoding.legacy_charset(t[i:j].encode(c)), c) for c, ts in SAMPLES.items() for t in ts for i in range(0, len(t) - 5, 3) for j in range(i + 6, len(t) + 1)]
    named = [(got, c) for (got, sure), c in right if sure > encoding.CONFIDENT]
    assert len(named) >= 0.97 * len(right) and sum(got == c for got, c in named) >= 0.995 * len(named)
    assert encoding.legacy_charset(b"plain") == (None, 0.0)
    assert encoding.legacy_charset("Größe und Maß für Übung".encode("latin-1"))[0] is None


def test_safe_names_and_broken_archives(spark):
    names = ["x/../y.txt", "x/y.txt", "z\\y.txt", "..", "dir\\a b.txt", "p/q/", "", "a[1]?*é.txt", "卷/第 一章.txt", "y.txt_1", "./."]
    members = spark.createDataFrame([("a", i, n) for i, n in enumerate(names)] + [("b", 0, "y.txt")], "filename string, member_pos int, member_name string")
    found = rows(library.safe_names(members).orderBy("filename", "member_pos"), "safe_name")
    assert [x for (x,) in found] == ["y.txt", "y.txt_1", "y.txt_2", "entry_3", "a_b.txt", "q", "entry_6", "a_1_.txt", "第_一章.txt", "y.txt_1", "entry_10", "y.txt"]
    assert library.members_of(spark.createDataFrame([("a", b"no archive"), ("b", None)], "filename string, content binary")).count() == 0


def test_search(spark):
    df = spark.createDataFrame([("Red widget", "Ann"), ("red bolt", "Wid Red"), (None, None)], "title string, author string")
    assert catalog.search(df, "RED wid").count() == 2
    assert catalog.search(df, "idge").count() == 1
    assert catalog.search(df, "nn").count() == 0


def test_missing_json(spark, tmp_path):
    assert library.read_json_or_empty(spark, f"file://{tmp_path}/none.json", "a string").count() == 0
    (tmp_path / "one.json").write_text('{"a": "x"}')
    assert library.read_json_or_empty(spark, f"file://{tmp_path}/one.json", "a string").first().a == "x"


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    schema = "user_id string, book_id string, updated_at long, seq long"
    save = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/saves")
    run = lambda: rows(keep_most_recent(spark.readStream.schema(schema).parquet(f"{tmp_path}/saves"), f"{tmp_path}/state", 2).orderBy("place"), "book_id", "seq")
    save([("u", "A", 1, 1), ("u", "B", 2, 2)])
    assert run() == [("B", 2), ("A", 1)]
    assert run() == [("B", 2), ("A", 1)]
    save([("u", "C", 3, 3), ("u", "A", 4, 4)])
    assert run() == [("A", 4), ("C", 3)]


def test_lenient_text(spark):
    data = "﻿汉字ab".encode()
    df = spark.createDataFrame([(data,), (data[:5],), (data[4:],)], "c binary")
    found = [r[0] for r in df.select(reader.lenient_text(F.col("c"))).collect()]
    assert found[0] == "汉字ab" and set(found[1]) == {"�"} and found[2].endswith("字ab")
