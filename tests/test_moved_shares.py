"""Moved places: the state's values are as many as shares, however many books readers have."""

import random

import pytest
from quire.operators.progress import moved
from quire.streaming import progress as sp


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_a_call_a_share(spark, tmp_path, rocks, monkeypatch):
    monkeypatch.setattr(sp, "SHARES", 8)
    r, schema, big = random.Random(6), "user_id long, book_id string, seq long, position long", 1 << 60
    rows = [(r.choice([None, big + r.randint(0, 300)]), r.choice(["a\"", None, "é"]), i, r.choice([None, r.randint(0, 400)])) for i in range(900)]
    for part in (rows[:500], rows[500:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = sp.emit_moved(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    found = spark.read.schema(schema).parquet(f"{tmp_path}/out")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, moved(spark.createDataFrame(rows, schema)).collect()))
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/state")
    assert 0 < held.count() <= 8
