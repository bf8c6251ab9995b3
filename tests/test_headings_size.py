"""Headings of few large books: work for all cores, patterns tried once a line."""

from quire.operators import headings


def test_lines_of_one_book_are_spread(spark):
    lines = spark.createDataFrame([("b", i, f"第{i}章 x") for i in range(1, 400)], "book_id string, line_no long, line string").coalesce(1)
    rows = headings.chapter_candidates(headings.segments(lines, headings.hierarchy(lines)))
    plan = rows.filter("chapter is not null").select("chapter.rest")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE form" not in plan and plan.count("regexp_instr(line") <= 12
    assert sum(n > 0 for n in rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) >= 4
