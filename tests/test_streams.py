"""Streams that keep state: tables by bucket, moved places, settled values; and as-of joins across ranges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from quire.operators import asof, headings
from quire.operators.progress import moved, most_recent, settled
from quire.sources.store import Store
from quire.streaming import progress as sp

SAVES = "user_id string, book_id string, updated_at long, seq long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def feed(spark, folder, rows, schema, run):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = run(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{folder}/out").collect()))


def test_saves_rewrite_their_own_buckets(spark, tmp_path):
    save = lambda rows: spark.createDataFrame(rows, SAVES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sorted(map(tuple, sp.keep_most_recent(spark.readStream.schema(SAVES).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", 2).collect()))
    rows = [(f"u{i}", f"b{i % 7}", i, i) for i in range(200)] + [("u1", "x", 500, 500)]
    save(rows)
    want = lambda: sorted(map(tuple, most_recent(spark.createDataFrame(rows, SAVES), 2).collect()))
    assert run() == want()
    store = Store(spark, f"{tmp_path}/t")
    before = store.last()["buckets"]
    for i in range(3):
        save([("u1", f"y{i}", 600 + i, 600 + i)])
        rows.append(("u1", f"y{i}", 600 + i, 600 + i))
        assert run() == want()
    after = store.last()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert len(store.numbers()) == 2
    sp.clear(spark, f"{tmp_path}/t")
    save([("u9", "z", 1, 1)])
    assert [x[:2] for x in run()] == [("u9", "z")]


def test_repeated_micro_batch(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("u", "a", 1, 1)], SAVES).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SAVES).parquet(f"{tmp_path}/in")
    with monkeypatch.context() as m:  # fails after its commit
        m.setattr(Store, "forget", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            sp.keep_most_recent(stream(), f"{tmp_path}/t")
    assert Store(spark, f"{tmp_path}/t").numbers() == [1]
    assert [r.book_id for r in sp.keep_most_recent(stream(), f"{tmp_path}/t").collect()] == ["a"]
    assert Store(spark, f"{tmp_path}/t").numbers() == [1]


def test_moved_places_over_micro_batches(spark, tmp_path, rocks):
    r = random.Random(3)
    schema = "user_id long, book_id string, seq long, position long"
    rows = [(r.randint(0, 3), r.choice("ab"), i, r.choice([None, r.randint(0, 400)])) for i in range(120)]
    for part in (rows[:70], rows[70:]):
        out = feed(spark, tmp_path, part, schema, sp.emit_moved)
    assert out == sorted(map(tuple, moved(spark.createDataFrame(rows, schema)).collect()))


def test_places_that_rest_are_forgotten(spark, tmp_path, rocks):
    schema, hour = "user_id long, book_id string, seq long, position long, at timestamp", 3_600
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    steps = [[(1, "a", 1, 300, at(0)), (2, "a", 2, 300, at(0))], [(2, "a", 3, 310, at(2 * hour))], [(2, "a", 4, 320, at(5 * hour))], [(1, "a", 5, 310, at(6 * hour)), (2, "a", 6, 330, at(6 * hour))]]
    for step in steps:
        out = feed(spark, tmp_path, step, schema, lambda x: sp.emit_moved(x, rest=4 * hour * 1000))
    assert sorted(x[2] for x in out) == [1, 2, 5]  # reader 1 begins anew, reader 2 has never rested so long


def test_settled_values_and_late_rows(spark, tmp_path):
    schema = "user_id long, event_id long, ms long, at timestamp"
    spark_rows = lambda rows: [(u, e, ms, None) for u, e, ms in rows]
    r = random.Random(4)
    rows = [(r.randint(0, 4), i, 1_000_000 + r.choice([0, 1, 799, 800, 801]) * r.randint(0, 30)) for i in range(200)]
    rows += [(9, 1000, 1_000_000), (9, 1001, 1_000_000), (9, 1002, 1_000_800), (9, 1003, 1_001_599)]

    def stream(x):
        return sp.settle(x.withColumn("at", F.timestamp_millis("ms")), "user_id", "at", F.col("event_id"), 800).select("user_id", "event_id", "ms")

    feed(spark, tmp_path, spark_rows(rows), schema, stream)
    feed(spark, tmp_path, spark_rows([(-1, -1, 9_000_000)]), schema, stream)
    late = [(9, 2000, 1_000_100)]  # of a run that is over
    out = feed(spark, tmp_path, spark_rows([*late, (-1, -2, 19_000_000)]), schema, stream)
    want = settled(spark.createDataFrame(rows, "user_id long, event_id long, ms long"), "user_id", "ms", "event_id", 800)
    assert [x for x in out if x[0] >= 0] == sorted(map(tuple, want.select("user_id", "event_id", "ms").collect()))


def test_next_starts_across_ranges(spark, tmp_path):
    r = random.Random(5)
    starts = [("hot", r.randint(0, 5000)) for _ in range(300)] + [("b", 5), ("b", 9), (None, 3), ("c", None)]
    targets = [("hot", r.randint(-10, 5200), i) for i in range(2000)] + [("b", 5, -1), ("b", 6, -2), ("b", 10, -3), ("none", 1, -4), (None, 1, -5), ("b", None, -6), ("b", 5, -1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = asof.next_starts(spark.createDataFrame(targets, "k string, at long, i long"), spark.createDataFrame(starts, "k string, at long"), "k", "at", f"{tmp_path}/asof").collect()
    want = [(k, at, i, min((s for kk, s in starts if kk == k and s is not None and at is not None and k is not None and s >= at), default=None)) for k, at, i in targets]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert len({f for f in (tmp_path / "asof").iterdir() if f.suffix == ".parquet"}) > 1


def test_packed_positions(spark, monkeypatch):
    monkeypatch.setattr(headings, "SEGMENT", 1000)
    lines = spark.createDataFrame([("b", i, "第一章 x" if i % 3 else "第二回") for i in (1, 2, 3, 129, 258, 999, 1000, 1001, 5000, 16_000_000)], "book_id string, line_no long, line string")
    found = headings.marker_positions(lines)
    assert sorted((r.marker, r.line_no) for r in headings.positions_of(found).collect()) == sorted(("章" if i % 3 else "回", i) for i in (1, 2, 3, 129, 258, 999, 1000, 1001, 5000, 16_000_000))
    assert found.agg(F.sum(F.octet_length("positions"))).first()[0] < 20
