"""A library's store: batches, losses between any two writes, sweeps, stored layout, streams of arrivals and of bytes."""

import io
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F
from quire.operators.chunking import whole_texts
from quire.operators.reader import read_windows
from quire.plans import ingest as ing
from quire.sources import library
from quire.sources.bytestream import LibraryError, book_bytes
from quire.sources.store import Store

TEXT = "\n".join(f"line {i} of a book" for i in range(40))


def archive(text):
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        z.writestr(zipfile.ZipInfo("x.txt"), b" ")
        z.writestr(zipfile.ZipInfo("y.TXT"), text.encode())
        z.writestr(zipfile.ZipInfo("z.txt"), b"later")
    return held.getvalue()


def archives(spark, texts):
    return spark.createDataFrame([(f"{n}.rar", archive(t)) for n, t in texts.items()], "filename string, content binary")


def stored(spark, root):
    """Books with their texts, and those with an index."""
    texts = {r.book_id: bytes(r.content).decode() for r in whole_texts(ing.live_parts(spark, root)).collect()}
    indexes = {r.book.id: (r.book.totalSize, len(r.book.parts)) for r in ing.live_indexes(spark, root).collect()}
    names = {r.book_id for r in ing.manifest_of(spark, root).collect()}
    assert set(texts) == set(indexes) == names
    return texts


def run_all(files, root, size=2, **how):
    out = []
    while not out or out[-1]["remaining"]:
        out.append(ing.run_batch(files, root, size, 200, **how))
    return out


def ids(texts):
    return {f"{n}-佚名": t for n, t in texts.items()}


def test_batches_changes_and_removals(spark, tmp_path):
    root, texts = f"{tmp_path}/lib", {f"b{i}": f"{TEXT}\n{i}" for i in range(5)} | {"short": "kurz"}
    assert ing.run_batch(archives(spark, {"x": TEXT}).limit(0), root)["books"] == 0 and not Store(spark, root).numbers()
    first = run_all(archives(spark, texts), root)
    assert [(x["processed"], x["failed"], x["remaining"], x["batches"]) for x in first] == [(2, 0, 4, 2), (2, 0, 2, 1), (1, 1, 0, 0)]
    del texts["short"]
    assert stored(spark, root) == ids(texts)
    for i in range(2):  # runs with one new book each lose nothing
        texts[f"n{i}"] = f"{TEXT} new {i}"
        assert run_all(archives(spark, texts), root)[-1]["books"] == 6 + i
    assert stored(spark, root) == ids(texts)
    texts["b1"], texts["b2"] = TEXT + " changed", "now too short"
    del texts["b3"]
    last = run_all(archives(spark, texts), root)
    assert (sum(x["processed"] for x in last), sum(x["failed"] for x in last), sum(x["removed"] for x in last)) == (1, 1, 1)
    texts["b2"] = f"{TEXT}\n2"  # a book that was usable before stays as it was
    assert stored(spark, root) == ids(texts)
    assert {r.book_id for r in ing.unreferenced(spark, root).collect()} == {"b1-佚名", "b3-佚名"}
    assert ing.sweep(spark, root, grace=2)["moved"] > 0
    ing.sweep(spark, root, grace=1)
    assert ing.unreferenced(spark, root).count() == 0 and stored(spark, root) == ids(texts)
    assert ing.sweep(spark, root, grace=1) == {"moved": 0, "parts": 0, "indexes": 0, "tables": 0}


def test_lost_index_is_built_again(spark, tmp_path):
    root, texts = f"{tmp_path}/lib", {"a": TEXT, "b": TEXT + "b"}
    run_all(archives(spark, texts), root, 1)
    Store(spark, root).remove(["indexes/batch=1"])
    again = run_all(archives(spark, texts), root)
    assert sum(x["processed"] for x in again) == 1 and stored(spark, root) == ids(texts)


class Lost(Exception):
    pass


def failing(monkeypatch, at):
    """The at-th write of the store (tables, parts, record) fails; the number of writes so far."""
    count = [0]

    def guard(f, after):
        def run(*a, **b):
            count[0] += 1
            if count[0] == at and not after:
                raise Lost
            out = f(*a, **b)
            if count[0] == at and after:
                raise Lost  # written, but its writer never heard
            return out

        return run

    monkeypatch.setattr(Store, "write", guard(Store.write, False))
    monkeypatch.setattr(Store, "commit", guard(Store.commit, False))
    monkeypatch.setattr(ing, "chunk_parts", guard(ing.chunk_parts, False))
    return count


def test_lost_between_any_two_writes(spark, tmp_path, monkeypatch):
    texts = {f"b{i}": f"{TEXT} {i}" for i in range(3)}
    changed = {**texts, "b0": TEXT + " changed", "new": TEXT}
    del changed["b2"]
    root = f"{tmp_path}/before"
    run_all(archives(spark, texts), root, None)
    shutil.copytree(root, f"{tmp_path}/whole")
    with monkeypatch.context() as m:
        count = failing(m, 0)
        run_all(archives(spark, changed), f"{tmp_path}/whole", None)
    assert count[0] == 8
    for at in range(1, count[0] + 1):
        root = f"{tmp_path}/lost{at}"
        shutil.copytree(f"{tmp_path}/before", root)
        with monkeypatch.context() as m:
            failing(m, at)
            with pytest.raises(Lost):
                run_all(archives(spark, changed), root, None)
        run_all(archives(spark, changed), root, None)
        assert stored(spark, root) == ids(changed)


def test_arrivals_as_a_stream(spark, tmp_path, monkeypatch):
    root, texts = f"{tmp_path}/lib", {f"b{i}": f"{TEXT} {i}" for i in range(4)}
    for n, t in texts.items():
        archives(spark, {n: t}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("filename string, content binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with monkeypatch.context() as m:
        failing(m, 14)
        with pytest.raises(Exception, match="Lost"):
            ing.ingest_stream(stream(), root, 200)
    assert len(ing.manifest_of(spark, root).collect()) < 4
    ing.ingest_stream(stream(), root, 200)
    assert stored(spark, root) == ids(texts)
    store = Store(spark, root)
    epochs = [store.record(n)["epoch"] for n in store.numbers()]
    assert epochs == sorted(set(epochs))
    archives(spark, {"b1": TEXT + " changed"}).write.mode("append").parquet(f"{tmp_path}/in")
    ing.ingest_stream(stream(), root, 200)
    assert stored(spark, root) == ids({**texts, "b1": TEXT + " changed"})
    with monkeypatch.context() as m:  # a micro-batch that was committed, but repeated, changes nothing
        number = store.last()["number"]
        m.setattr(Store, "last", lambda self, f=Store.last: f(self) | {"epoch": 99})
        archives(spark, {"b2": TEXT + " changed"}).write.mode("append").parquet(f"{tmp_path}/in")
        ing.ingest_stream(stream(), root, 200)
    assert store.last()["number"] == number


def test_folder_of_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, t in {"《名》作者：人": TEXT, "b[1] x": TEXT + "1", "c": TEXT + "2"}.items():
        (tmp_path / "in" / f"{n}.RAR").write_bytes(archive(t))
    (tmp_path / "in" / "other.zip").write_bytes(b"")
    opened = []

    def files(names):
        opened.append(names)
        return library.scan_archives(spark, f"{tmp_path}/in", names=names)

    assert [x["processed"] for x in run_all(files, f"{tmp_path}/lib")] == [2, 1]
    assert set(stored(spark, f"{tmp_path}/lib")) == {"名-人", "b-1-x-佚名", "c-佚名"}
    assert [x and len(x) for x in opened] == [None, 2, 1]  # later batches open their own files alone


def test_windows_move_no_parts(spark, tmp_path):
    root = f"{tmp_path}/lib"
    run_all(archives(spark, {f"b{i}": f"{TEXT} {i}" for i in range(6)}), root, None)
    windows = spark.createDataFrame([(i, f"b{i % 6}-佚名", 7 * i, 300) for i in range(30)], "window_id long, book_id string, start_byte long, length long")
    out = read_windows(windows, ing.live_parts(spark, root))
    found = {r.window_id: bytes(r.content) for r in out.collect()}
    assert found == {i: f"{TEXT} {i % 6}".encode()[7 * i : 7 * i + 300] for i in range(30)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan names the buckets of a filter
    try:
        for df in (read_windows(windows, ing.live_parts(spark, root)), whole_texts(ing.live_parts(spark, root))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("== Initial Plan ==")[-1].splitlines()
            scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "content" in x)
            depth = lines[scan].index("FileScan")
            above = []
            for x in reversed(lines[:scan]):  # the scan's ancestors
                at = len(x) - len(x.lstrip(" :+-*()0123456789"))
                if at < depth:
                    above.append(x)
                    depth = at
            assert not [x for x in above if "Exchange" in x], plan
        one = spark.table(ing.parts_table(spark, root)).filter("book_id = 'b1-佚名'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "SelectedBucketsCount: 1 out of 16" in one and "EqualTo(book_id" in one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_book_as_a_stream_of_bytes(spark, tmp_path):
    root, text = f"{tmp_path}/lib", "\n".join(f"{i} " + "é" * 50 for i in range(200))
    run_all(archives(spark, {"b": text, "c": TEXT}), root, None)
    parts = list(book_bytes(spark, root, "b-佚名", ahead=3))
    assert len(parts) > 20 and max(map(len, parts)) < 400 and b"".join(parts).decode() == text
    stream = book_bytes(spark, root, "b-佚名", ahead=2)
    assert next(stream) == parts[0]
    stream.close()
    for book, status in (("", 400), ("none", 404)):
        with pytest.raises(LibraryError) as e:
            next(book_bytes(spark, root, book))
        assert e.value.status == status


def test_two_writers_can_not_take_the_same_number(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.commit(1, {"a": 1})
    with pytest.raises(RuntimeError):
        store.commit(1, {"a": 2})
    assert store.last() == {"a": 1, "number": 1} and spark.range(1).select(F.lit(1)).count() == 1
