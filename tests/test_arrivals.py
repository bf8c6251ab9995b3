"""Arrivals of one book that meet in a micro-batch, and files that a library holds twice."""

import io
import zipfile

from pyspark.sql import functions as F
from quire.operators.chunking import whole_texts
from quire.plans import ingest as ing
from quire.sources import library

TEXT = "\n".join(f"line {i} of a book" for i in range(40))


def archive(text):
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        z.writestr(zipfile.ZipInfo("x/"), b"")
        z.writestr(zipfile.ZipInfo("x.txt"), "　 \n".encode())
        z.writestr(zipfile.ZipInfo("y.TXT"), text)
        z.writestr(zipfile.ZipInfo("z.txt"), b"later")
    return held.getvalue()


def texts_of(spark, root):
    return {r.book_id: bytes(r.content).decode() for r in whole_texts(ing.live_parts(spark, root)).collect()}


def test_last_usable_arrival_of_a_micro_batch(spark, tmp_path):
    """Whatever the micro-batches, a book is what its last usable file says."""
    schema = "filename string, content binary, arrived int"
    versions = [[("a", TEXT), ("b", TEXT), ("c", TEXT)], [("a", TEXT + " 2"), ("b", TEXT + " 0"), ("c", "short"), ("d", TEXT)], [("a", TEXT + " 1"), ("b", "short"), ("d", TEXT)]]
    rows = [(f"{n}.rar", archive(t.encode()), i) for i, v in enumerate(versions) for n, t in v]
    spark.createDataFrame(rows[::-1], schema).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    ing.ingest_stream(stream, f"{tmp_path}/lib", 200)
    assert texts_of(spark, f"{tmp_path}/lib") == {"a-佚名": TEXT + " 1", "b-佚名": TEXT + " 0", "c-佚名": TEXT, "d-佚名": TEXT}


def test_a_file_given_twice_is_one_book(spark, tmp_path):
    files = spark.createDataFrame([("a.rar", archive(TEXT.encode())), ("a.rar", archive(TEXT.encode())), ("b.rar", archive(TEXT.encode()))], "filename string, content binary")
    assert ing.run_batch(files, f"{tmp_path}/lib", None, 200)["processed"] == 2
    assert texts_of(spark, f"{tmp_path}/lib") == {"a-佚名": TEXT, "b-佚名": TEXT}
    none = spark.createDataFrame([], "book_id string, hash string")
    parts, indexes, rows = ing.ingest(files, none, none.select("book_id"), 200)
    assert rows.count() == indexes.count() == 2 and {r.book_id: bytes(r.content).decode() for r in whole_texts(parts).collect()} == {"a-佚名": TEXT, "b-佚名": TEXT}


def test_tasks_hand_on_texts_in_steps(spark, monkeypatch):
    """Character sets as `decoded` reads them; a step of a task holds few texts; what can't be opened has none."""
    texts = {"u": TEXT.encode(), "m": b"\xff\xfe" + TEXT.encode("utf-16-le"), "g": ("天色渐渐暗了下来，他站在窗前望着远处的山峦。\n" * 20).encode("gb18030")}
    files = spark.createDataFrame([*((n, archive(t)) for n, t in texts.items()), ("broken", b"PK"), ("null", None)], "filename string, content binary")
    monkeypatch.setattr(library, "STEP_BYTES", 1)
    found = {r.filename: r.text for r in library.first_texts(files).collect()}
    assert found == {"u": TEXT, "m": TEXT, "g": ("天色渐渐暗了下来，他站在窗前望着远处的山峦。\n" * 20).strip()}
    sizes = library.members_of(files).groupBy(F.spark_partition_id()).count().agg(F.sum("count")).first()[0]
    assert sizes == 12
