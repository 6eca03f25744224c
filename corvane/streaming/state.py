"""Streams with state of their own: keep-latest by key with timers, and rows that come too late, counted.

Both run on any file or message source. State lives in RocksDB and in the checkpoint folder, so a query that stops goes on where it
was.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEVERAL_STEPS = "spark.sql.streaming.statefulOperator.allowMultiple"


def with_state_store(spark: SparkSession) -> None:
    """Processors with timers need RocksDB as the session's state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class KeepLatest(StatefulProcessor):
    """The row of a key that is largest by `order`, as value state; an update whenever it changes.

    Rows whose first order column is null come before all others. With `idle_ms`, a key without a new row for so long (by the
    watermark) is forgotten: a timer clears its state, and a later row of it starts anew."""

    def __init__(self, order: list[str], fields: list[str], types: T.StructType, idle_ms: int | None):
        self.order, self.fields, self.types, self.idle_ms = order, fields, types, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.types)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = self.best.get() if self.best.exists() else None
        rank = lambda r: tuple((x is not None and x == x, x if x is not None and x == x else 0) for x in r[: len(self.order)])
        changed = False
        for pdf in rows:
            for row in pdf[self.fields].itertuples(index=False, name=None):
                if best is None or rank(row) > rank(best):
                    best, changed = tuple(None if x != x else x for x in row), True
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + self.idle_ms)
        if changed:
            self.best.update(best)
            yield pd.DataFrame([(*key, *best)], columns=[*self.keys, *self.fields])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.best.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_by_state(df: DataFrame, keys: list[str], order: list[str], values: list[str], *, idle_ms: int | None = None) -> DataFrame:
    """A stream of updates (keys, order, values): whenever a key's largest row by `order` changes; of equal rows the first stays. Null and
    NaN come before all others. With idle_ms df needs a watermark.

    Without idle_ms no key needs a timer, and the state is that of an aggregate; a call of Python for each key and batch is left to KeepLatest."""
    with_state_store(df.sparkSession)
    fields = [*order, *values]
    if idle_ms is None:
        return _latest_by_aggregate(df, keys, order, fields)
    processor = KeepLatest(order, fields, T.StructType([df.schema[c] for c in fields]), idle_ms)
    processor.keys = keys
    out = T.StructType([df.schema[c] for c in [*keys, *fields]])
    return df.groupBy(*keys).transformWithStateInPandas(processor, out, "Update", "EventTime")


def _latest_by_aggregate(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Each row carries the time of its batch, the same for all of a batch: a key whose largest row is of the present one has changed."""
    now = F.unix_micros(F.current_timestamp())
    known = lambda c: F.when(~F.isnan(c), F.col(c)) if isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType) else F.col(c)
    first = F.struct((-now).alias("since"), (-F.col("_place")).alias("place"))  # of equal rows the first is largest
    schema = T.StructType([*df.schema.fields, T.StructField("_place", T.LongType())])
    arrow = to_arrow_schema(schema)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + b.num_rows), pa.int64())], schema=arrow)
            n += b.num_rows

    x = df.mapInArrow(numbered, schema)  # streams know no monotonically_increasing_id
    x = x.select(*keys, F.struct(*fields).alias("_row"), F.struct(*(known(c).alias(f"o{i}") for i, c in enumerate(order)), first.alias("first")).alias("_order"))
    best = x.groupBy(*keys).agg(F.max_by("_row", "_order").alias("_row"), F.max("_order").alias("_order"))
    return best.filter(F.col("_order.first.since") == -now).select(*keys, "_row.*")


def write_updates(df: DataFrame, path: str) -> StreamingQuery:
    """Writes each batch's updates to a folder of its own (a batch that is run again replaces it), until the present input is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/updates/n={batch_id}")

    query = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rows = spark.read.parquet(f"{path}/updates").drop("n")
    w = W.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", "batch")


class Dropped(StreamingQueryListener):
    """Adds up what the engine reports on queries, batch by batch: rows read, dropped as late, dropped as repeated."""

    def __init__(self) -> None:
        self.read = self.late = self.repeated = 0
        self.over = threading.Event()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        self.read += event.progress.numInputRows
        for op in event.progress.stateOperators:
            self.late += op.numRowsDroppedByWatermark
            self.repeated += op.customMetrics.get("numDroppedDuplicateRows", 0)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.over.set()


def count_windows(df: DataFrame, path: str, *, key: str, at: str, width: str, late: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """(start, end, n) of the rows of each window, and one row (read, late, repeated): how many rows were read, came after
    the watermark had passed them, and repeated a key within the watermark's reach. Late and repeated rows are in no window.
    A batch's rows are held against the watermark of all batches before it. (A query that may have several stateful steps, Spark's
    default, drops by the watermark of one batch earlier, for the sake of the second step; this one has a single step.)

    The engine counts what it drops in the query's progress; rows are dropped one by one, before anything is added
    up, so the counts are exact. Each batch writes its own counts by window, which are added up on reading; a batch that is run again replaces
    its own."""
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(F.window(at, width)).agg(F.count("*").alias("n")).select("window.*", "n").write.mode("overwrite").parquet(f"{path}/windows/b={batch_id}")

    seen = df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    dropped = Dropped()
    spark.streams.addListener(dropped)
    several = spark.conf.get(SEVERAL_STEPS)
    spark.conf.set(SEVERAL_STEPS, "false")
    try:
        query = seen.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped.over.wait(60)  # reports come in order, the end last
    finally:
        spark.conf.set(SEVERAL_STEPS, several)
        spark.streams.removeListener(dropped)
    run = spark.range(1).select(*(F.lit(n).cast("bigint").alias(c) for c, n in (("read", dropped.read), ("late", dropped.late), ("repeated", dropped.repeated))))
    run.write.mode("overwrite").parquet(f"{path}/figures/run={query.runId}")
    windows = spark.read.parquet(f"{path}/windows").groupBy("start", "end").agg(F.sum("n").alias("n"))
    totals = spark.read.parquet(f"{path}/figures").agg(*(F.sum(c).alias(c) for c in ("read", "late", "repeated")))  # a row a run
    return windows, totals
