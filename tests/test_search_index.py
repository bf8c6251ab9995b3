"""The search index against the scan, updates that touch their own buckets alone, and reads that are pruned."""

import pytest
from pyspark.sql import functions as F
from quire.operators import search_index as si
from quire.operators.catalog import search

BOOKS = [("1", "Red widget", "Ann Lee"), ("2", "red bolt", "Wid Red"), ("3", None, None), ("4", "", ""), ("5", "第一章 风起", "作者"), ("6", "a-b c", "x"), ("7", "Ünïcode Straße 12", "Øre"), ("8", "reddish wide", "Bo"), ("9", "red red red", "ed"), ("10", "x" * 300 + "yz", "q" * 40)]
QUERIES = ["RED wid", "idge", "nn", "ann le", " -- ", "风", "b c", "straße 1", "xyz", "q" * 41, "1 2"]


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def index(spark, tmp_path):
    out = si.SearchIndex(spark, f"{tmp_path}/index")
    out.update(spark.createDataFrame(BOOKS, si.BOOKS))
    return out


def test_same_as_scan(spark, index):
    df = spark.createDataFrame(BOOKS, si.BOOKS)
    for q in QUERIES:
        assert found(index.search(q)) == found(search(df, q)), q


def test_updates(spark, index):
    now = {b[0]: b for b in BOOKS}
    many = [(f"m{i}", f"title {i} of many", f"author {i}") for i in range(60)]
    steps = [([("2", "blue nut", "Wid Red"), ("11", "new red", "N")], []), ([], ["1", "none"]), ([("3", "now red", "A"), ("3", "also red", "B"), (None, "red", "x")], ["3"]), (many, ["2"])]
    for changed, gone in steps:
        for b in sorted(changed, key=lambda x: (x[0] or "", x[1])):
            if b[0]:
                now[b[0]] = b
        for g in gone:
            if g not in {b[0] for b in changed}:
                now.pop(g, None)
        index.update(spark.createDataFrame(changed, si.BOOKS), spark.createDataFrame([(g,) for g in gone], "id string"))
        df = spark.createDataFrame(list(now.values()), si.BOOKS)
        for q in ("red", "title 1", ""):
            assert found(index.search(q)) == found(search(df, q)), (changed, q)
    index.compact()
    assert len(index.store.children("postings")) == 1
    for q in ("red", "author 5", ""):
        assert found(index.search(q)) == found(search(df, q)), q


def test_update_touches_its_own_buckets(spark, index):
    before = index.store.last()["books"]
    touched = index.update(spark.createDataFrame([("77", "ab", "c")], si.BOOKS))
    after = index.store.last()["books"]
    assert touched["books"] == 1 and sum(before.get(b) != n for b, n in after.items()) == 1
    assert touched["postings"] <= 4  # a, b, ab and the author's c


def test_search_reads_few_buckets(spark, index):
    """Only the folders of the query's buckets are listed as read."""
    plan = index.candidates("widget")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan
    read = index.postings().filter(F.col("bucket").isin([1, 2]))
    assert {f.split("bucket=")[1].split("/")[0] for (f,) in read.select(F.input_file_name()).distinct().collect()} <= {"1", "2"}


def test_lost_update(spark, index, monkeypatch):
    """An update that fails before its record changes nothing, and the next one takes its place."""
    want = found(index.search("red"))
    with monkeypatch.context() as m:
        m.setattr(si.Store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.update(spark.createDataFrame([("1", "gone", "x")], si.BOOKS))
    assert found(index.search("red")) == want
    index.update(spark.createDataFrame([("12", "red", "x")], si.BOOKS))
    assert found(index.search("red")) == sorted([*want, ("12", "red", "x")])
