"""Structured Streaming counterparts: append-only manifests, session windows of faults, keep-latest, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import manifest as M


def fault_sessions(events: DataFrame, key: str, at: str, before: int, after: int, gap: int, late: str = "10 minutes") -> DataFrame:
    """Merged fault windows of a stream of anchors: padded intervals merge iff anchors are at most before + after + gap
    seconds apart, which is a session gap. Rows older than the watermark are dropped and counted by the engine."""
    total = before + after + gap
    stamped = events.withWatermark(at, late) if events.isStreaming else events
    # a session ends before its last event plus the gap: one microsecond more joins events exactly that far apart
    session = F.session_window(at, f"{total} seconds 1 microseconds")
    agg = stamped.groupBy(session, key).agg(F.count("*").alias("n_anchors"), F.min(at).alias("first"), F.max(at).alias("last"))
    return agg.select(key, (F.col("first") - F.expr(f"interval {before} seconds")).alias("win_start"), (F.col("last") + F.expr(f"interval {after} seconds")).alias("win_end"), "n_anchors")


def keep_latest_stream(df: DataFrame, key: str, epoch: str, value: str) -> DataFrame:
    """(key, epoch, value): an update whenever a later record of a key arrives; equally late ones change nothing."""
    import pandas as pd

    def step(k, batches, state: GroupState):
        best = state.get if state.exists else (float("-inf"), None)
        changed = False
        for pdf in batches:
            for e, v in pdf[[epoch, value]].itertuples(index=False):
                e = -1.0 if e is None or e != e else float(e)
                if e > best[0]:
                    best, changed = (e, v), True
        if changed:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], "epoch": [best[0]], "value": [best[1]]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} string, epoch double, value string", "epoch double, value string", "update", GroupStateTimeout.NoTimeout)


def manifest_writer(path: str, schema: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: appends what the manifest lacks; a replayed batch finds its versions there and adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").json(path)
        log = spark.read.schema(f"{schema}").json(path).withColumn("_pos", F.col("_metadata.file_modification_time"))
        new = M.changed_records(batch.dropDuplicates(["asset_id"]), log, F.col("manifest_emitted_at"))
        new.withColumn("manifest_emitted_at", F.current_timestamp()).drop("_pos").write.mode("append").json(path)

    return write


def upsert_writer(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: a keyed Parquet table in versions; each batch writes the next one and moves the pointer last."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        target = f"{path}/v={batch_id}"
        earlier = _versions(spark, path, batch_id)
        out = M.upsert(spark.read.parquet(f"{path}/v={earlier}"), rows, key) if earlier is not None else rows
        out.write.mode("overwrite").parquet(target)

    return write


def _versions(spark, path: str, before: int) -> int | None:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    have = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    have = [v for v in have if v < before and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/_SUCCESS"))]
    return max(have, default=None)


def new_passage_writer(path: str, schema: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: appends passages that the table lacks."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
        M.new_passages(batch.dropDuplicates(["document"]), spark.read.schema(schema).parquet(path)).write.mode("append").parquet(path)

    return write


def last_steps(runs: DataFrame) -> DataFrame:
    """The last record of each run."""
    return M.latest(runs, ["run_id"], [F.desc("ts")])
