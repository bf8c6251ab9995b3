"""Reading progress as streams: the most recently used books, places worth saving, and searches that have settled."""

from __future__ import annotations

import pickle
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.progress import KEPT, most_recent
from ..sources.store import Store

#: Buckets of readers, and shares of the readers' books whose places are one value of a stream's state.
BUCKETS, SHARES = 64, 2048


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="quire-")).rstrip("/")


def keep_most_recent(saves: DataFrame, root: str, most: int = KEPT) -> DataFrame:
    """Runs the stream `saves` (user_id, book_id, updated_at, seq, ...) as far as it has input and returns the table.

    State and table lie under `root`; another run with the same root goes on from there. The table is bucketed by reader:
    a micro-batch joins the buckets of its readers with their most recent books and writes these buckets alone, then a
    commit record says which commit wrote each bucket last. A micro-batch that is repeated after a loss is skipped if it
    was committed, and written anew if it wasn't. What no record names any more goes with the commit after next.
    """
    spark = saves.sparkSession
    columns = saves.columns
    schema = most_recent(spark.createDataFrame([], saves.schema), most).schema
    store = Store(spark, root)

    def held(record: dict, buckets: set[int] | None = None) -> DataFrame:
        places = [f"{store.place('table', n)}/bucket={b}" for b, n in record.get("buckets", {}).items() if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)

    def merge(batch: DataFrame, epoch: int) -> None:
        last = store.last()
        if last.get("epoch", -1) >= epoch:
            return
        number, bucket = last["number"] + 1, F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")
        rows = store.write(batch, "arrived", number)
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # BUCKETS at most
        following = most_recent(held(last, touched).select(*columns).unionByName(rows), most).withColumn("bucket", bucket)
        store.write(following, "table", number, "bucket")
        store.commit(number, {"epoch": epoch, "buckets": last.get("buckets", {}) | {str(b): number for b in touched}})
        store.forget(2)
        named = {str(n) for k in store.numbers() for n in store.record(k)["buckets"].values()}
        store.remove([f"arrived/{number}", *[f"table/{n}" for n in store.children("table") if n not in named]])

    query = saves.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root.rstrip('/')}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return held(store.last())


def clear(spark: SparkSession, root: str) -> None:
    """Forget all saves of the table under `root`; the stream goes on from where it is."""
    store = Store(spark, root)
    last = store.last()
    store.commit(last["number"] + 1, {"epoch": last.get("epoch", -1), "buckets": {}})


class Moved(StatefulProcessor):
    """For a share of the readers' books the last places that were kept, and the event times until which they count: `rest` milliseconds past the last scroll.

    The places of a share are one value, read and written once a micro-batch: a call for each book would cost far more than its rows.
    """

    def __init__(self, least: int, rest: int):
        self.least, self.rest = least, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "places binary")

    def places(self, now: int) -> dict[str, tuple[int, int]]:
        """Places by book that still count."""
        held = pickle.loads(self.held.get()[0]) if self.held.exists() else {}
        return {k: x for k, x in held.items() if x[1] > now} if self.rest else held

    def keep(self, held: dict[str, tuple[int, int]]) -> None:
        if not held:
            self.held.clear()
            return
        self.held.update((pickle.dumps(held),))
        if self.rest:
            self.handle.registerTimer(min(until for _, until in held.values()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.places(timerValues.getCurrentWatermarkInMs() if self.rest else 0)
        every, kept = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        for book, at, known, millis in zip(every["book"].tolist(), every["position"].tolist(), every["known"].tolist(), every["millis"].tolist(), strict=True):
            last, until = held.get(book, (0, 0))
            moves = known and abs(at - last) > self.least
            held[book] = (at if moves else last, max(until, millis + self.rest))
            kept.append(moves)
        self.keep(held)
        if any(kept):
            yield every.loc[kept, ["book", "seq", "position"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            self.keep(self.places(expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def emit_moved(scrolls: DataFrame, least: int = 100, rest: int = 0, time: str = "at", late: str = "0 seconds") -> DataFrame:
    """The stream of those `scrolls` (user_id, book_id, seq, position) over `least` away from the reader's last kept one in
    the book, which is 0 at first. The state is one place a reader and book, in SHARES values by hash; with `rest` it goes when the event time `time`
    of the stream is so many milliseconds past the reader's last scroll there, and rows over `late` behind it are dropped.

    Rows of a micro-batch are taken by seq; micro-batches follow each other as they come. Needs the RocksDB state store.
    """
    who = scrolls.select("user_id", "book_id").schema
    rows = scrolls.withWatermark(time, late).withColumn("millis", F.unix_millis(time)) if rest else scrolls.withColumn("millis", F.lit(0).cast("long"))
    share = F.pmod(F.xxhash64("user_id", "book_id"), F.lit(SHARES)).cast("int").alias("share")
    place = [F.coalesce("position", F.lit(0).cast(scrolls.schema["position"].dataType)).alias("position"), F.col("position").isNotNull().alias("known")]
    rows = rows.select(share, F.to_json(F.struct("user_id", "book_id")).alias("book"), "seq", *place, "millis", *[time] * bool(rest))
    kept = StructType([StructField("book", StringType()), scrolls.schema["seq"], scrolls.schema["position"]])
    out = rows.groupBy("share").transformWithStateInPandas(Moved(least, rest), kept, "append", "eventtime" if rest else "none")
    return out.select(F.from_json("book", who).alias("x"), "seq", "position").select("x.user_id", "x.book_id", "seq", "position")


def settle(values: DataFrame, key: str, time: str, order: Column, delay: int = 250, late: str = "0 seconds") -> DataFrame:
    """The stream of the last of each run of `values` of a key that follow each other in less than `delay` milliseconds, when the run is over.

    Runs are session windows of the event time `time`; of equal times the greater `order` is later. A run is over when an
    event of the whole stream is `delay` and `late` past its end; rows that come later than `late` after it are dropped.
    """
    rest = [c for c in values.columns if c != key]
    gap = f"{delay * 1000 - 1} microseconds"  # windows that touch are one
    runs = values.withWatermark(time, late).groupBy(F.session_window(time, gap), F.col(key))
    return runs.agg(F.max_by(F.struct(*rest), F.struct(F.col(time), order)).alias("x")).select(key, "x.*")
