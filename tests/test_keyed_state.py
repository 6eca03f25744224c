"""The keyed table and the streams with state."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.plans import catalog
from corvane.sources.keyed import KeyedTable, keyed_writer
from corvane.streaming import state as ST


def rows(df):
    return sorted(map(tuple, df.collect()))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_only_its_own_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", buckets=8)
    base = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert t.upsert(base, 0) == {"written": 40_000, "compacted": 0}
    whole = size(tmp_path)
    one = base.filter("k % 100 = 3").withColumn("v", F.upper("v"))
    assert t.upsert(one, 1) == {"written": 400, "compacted": 0}
    assert size(tmp_path) - whole < 0.03 * whole
    want = rows(base.withColumn("v", F.when(F.col("k") % 100 == 3, F.upper("v")).otherwise(F.col("v"))))
    assert rows(t.read()) == want
    before = size(tmp_path)
    assert t.upsert(base, 1) == {"written": 0, "compacted": 0}  # a batch that comes again
    assert size(tmp_path) == before and rows(t.read()) == want


def test_deletes_compaction_and_clean(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", buckets=4, slack=0.3)
    make = lambda pairs: spark.createDataFrame(pairs, "k string, v int")
    with pytest.raises(ValueError):
        t.read()
    t.upsert(make([(str(i), i) for i in range(40)] + [(None, 1)]), 10)
    state = {str(i): i for i in range(40)}
    compacted = 0
    for n in range(6):
        change = [(str(i), 100 * n + i) for i in range(n, 60, 5)]
        gone = {str(i) for i in range(n, 60, 10)}
        done = t.upsert(make(change + [(k, -1) for k, _ in change]), 11 + n, position=F.col("v"), gone=F.col("k").isin(*gone))
        state.update(change)
        state = {k: v for k, v in state.items() if k not in gone}
        compacted += done["compacted"]
        assert rows(t.read()) == sorted(state.items())
    assert compacted
    before = size(tmp_path)
    t.clean()
    assert size(tmp_path) < before and rows(t.read()) == sorted(state.items())
    t.upsert(t.read(), 30, gone=F.lit(True))
    assert t.read().isEmpty()
    t.upsert(make([]), 31)
    t.upsert(make([("x", 1)]), 32)
    assert rows(t.read()) == [("x", 1)]


def test_stream_into_a_keyed_table(spark, tmp_path):
    src = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(k, n * 10 + j, j) for k in range(n, n + 4) for j in range(2)], "k int, v int, pos int").coalesce(1).write.mode("append").parquet(src)
    t = KeyedTable(spark, str(tmp_path / "table"), "k", buckets=2)
    stream = spark.readStream.schema("k int, v int, pos int").option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.foreachBatch(keyed_writer(t, position="pos")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(t.read().select("k", "v")) == [(0, 1), (1, 11), (2, 21), (3, 21), (4, 21), (5, 21)]


SCHEMA = "k string, at bigint, v string, ts timestamp"


def add(spark, path, batch):
    spark.createDataFrame(batch, "k string, at bigint, v string, sec bigint").select("k", "at", "v", F.timestamp_seconds("sec").alias("ts")).coalesce(1).write.mode("append").parquet(path)


def test_latest_by_state_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    add(spark, src, [("a", 5, "five", 0), ("b", None, "null", 0), ("a", 5, "equal", 0)])
    add(spark, src, [("a", 3, "older", 0), ("b", 1, "one", 0)])
    ST.write_updates(ST.latest_by_state(stream(), ["k"], ["at"], ["v"]), out)
    assert rows(ST.read_updates(spark, out, ["k"])) == [("a", 5, "five"), ("b", 1, "one")]
    n = spark.read.parquet(f"{out}/updates").count()
    add(spark, src, [("a", 4, "still older", 0), ("b", 0, "older", 0), ("c", None, None, 0)])
    add(spark, src, [("a", 6, "six", 0)])
    ST.write_updates(ST.latest_by_state(stream(), ["k"], ["at"], ["v"]), out)
    assert [(r.k, r.v) for r in ST.read_updates(spark, out, ["k"]).orderBy("k").collect()] == [("a", "six"), ("b", "one"), ("c", None)]
    assert spark.read.parquet(f"{out}/updates").count() == n + 2  # older rows make no update


def test_latest_by_state_calls_no_python(spark, tmp_path):
    """Null and NaN come first, of equal rows in one batch or two the first stays, and a key that doesn't change makes no update."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, at double, m int, v double"
    for batch in ([("a", float("nan"), 1, 1.0), ("a", None, 2, None), ("b", 1.0, 5, 3.0), ("b", 1.0, 5, 4.0), (None, 1.0, 1, 1.0)], [("a", float("nan"), 0, 5.0), ("b", 1.0, 5, 6.0), ("b", 1.0, None, 7.0)], [("b", 1.0, 6, 8.0), ("a", -1.0, None, 9.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    updates = ST.latest_by_state(stream, ["k"], ["at", "m"], ["v"])
    assert "InPandas" not in updates._jdf.queryExecution().logical().toString()
    ST.write_updates(updates, out)
    got = {(r.batch, r.k): (r.m, r.v) for r in spark.read.parquet(f"{out}/updates").collect()}
    assert got == {(0, "a"): (2, None), (0, "b"): (5, 3.0), (0, None): (1, 1.0), (2, "b"): (6, 8.0), (2, "a"): (None, 9.0)}


def test_idle_keys_are_forgotten(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("ts", "1 second")
    add(spark, src, [("a", 9, "first", 1000)])
    add(spark, src, [("b", 1, "clock", 2000)])
    add(spark, src, [("b", 2, "clock", 3000)])
    add(spark, src, [("b", 3, "clock", 4000)])
    add(spark, src, [("a", 1, "anew", 4001)])
    ST.write_updates(ST.latest_by_state(stream(), ["k"], ["at"], ["v"], idle_ms=60_000), out)
    assert [(r.k, r.v) for r in ST.read_updates(spark, out, ["k"]).orderBy("k").collect()] == [("a", "anew"), ("b", "clock")]


def test_late_and_repeated_rows_are_counted(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    add(spark, src, [("a", 1, "", 100), ("b", 1, "", 3700), ("a", 1, "", 100)])
    add(spark, src, [("c", 1, "", 7300)])
    add(spark, src, [("d", 1, "", 200), ("e", 1, "", 300), ("f", 1, "", 7200)])
    w, t = ST.count_windows(stream(), out, key="k", at="ts", width="1 hour")
    assert sorted((int(r.start.timestamp()), r.n) for r in w.collect()) == [(0, 1), (3600, 1), (7200, 2)]
    assert tuple(t.first()) == (7, 2, 1)
    add(spark, src, [("g", 1, "", 10), ("h", 1, "", 7201)])
    w, t = ST.count_windows(stream(), out, key="k", at="ts", width="1 hour")
    assert sorted((int(r.start.timestamp()), r.n) for r in w.collect()) == [(0, 1), (3600, 1), (7200, 3)]
    assert tuple(t.first()) == (9, 3, 1)


def test_a_row_is_late_by_the_watermark_of_the_batch_before(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, src, [("a", 1, "", 1000)])
    add(spark, src, [("b", 1, "", 9000)])
    add(spark, src, [("late", 1, "", 900), ("c", 1, "", 9100)])  # within ten minutes of the first batch's end, long before the second's
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    w, t = ST.count_windows(stream, out, key="k", at="ts", width="1 hour")
    assert sorted((int(r.start.timestamp()), r.n) for r in w.collect()) == [(0, 1), (7200, 2)]
    assert tuple(t.first()) == (4, 1, 0)


def test_late_rows_of_more_than_a_month(spark, tmp_path):
    """A sixth period and later ones are read too."""
    rows = [(i, 1_704_067_200 + i * 40_000) for i in range(1, 100)]  # 46 days
    spark.createDataFrame(rows, "event_id bigint, sec bigint").select("event_id", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["str07_late_rows"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == 99 and {(r.late, r.repeated) for r in got} == {(0, 1)}
