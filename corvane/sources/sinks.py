"""Sinks, and the cut of lineage for iterative operators."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, one of our own, in local mode only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc = spark.sparkContext
    if not getattr(sc, "_corvane_steps", None):
        sc._corvane_steps = tempfile.mkdtemp(prefix="corvane-")
    return sc._corvane_steps


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by checkpoint() in the folder the cluster names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def append_json(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """Appends rows as JSON lines; a dry run only counts them."""
    n = df.count()
    if n and not dry_run:
        df.write.mode("append").json(path)
    return n


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").partitionBy(key).json(path)


def write_sheets(df: DataFrame, path: str) -> None:
    """CSV with a header, a folder per sheet; the header begins with a byte order mark as spreadsheets want."""
    first = next(c for c in df.columns if c != "sheet")
    df.withColumnRenamed(first, f"\ufeff{first}").write.mode("overwrite").partitionBy("sheet").option("header", "true").option("encoding", "UTF-8").csv(path)


def append_run(spark, path: str, **record) -> None:
    """One JSON line on a finished step: ts, run_id, step_id, script, status, files_processed, detail, error."""
    row = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else v for k, v in record.items()}
    spark.createDataFrame([{k: None if v is None else str(v) for k, v in row.items()}], ", ".join(f"{k} string" for k in row)).coalesce(1).write.mode("append").json(path)


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A report of a few rows as a markdown table."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()])


def badge(score: int) -> str:
    colour = "green" if score >= 70 else "yellow" if score >= 40 else "red"
    return json.dumps({"schemaVersion": 1, "label": "governance", "message": f"{score}/100", "color": colour})


def to_csv_text(rows, bom: bool = True):
    """Array of string arrays as CSV text: quotes become apostrophes, line ends spaces."""
    cell = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), '"', "'"), r"[\r\n]+", " "), F.lit('"'))
    body = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), ",")), "\n")
    return F.concat(F.lit("﻿"), body) if bom else body


def shared_path(spark, name: str) -> str:
    """A new path in the folder the cluster names in spark.checkpoint.dir; only where that is unset a temporary one."""
    import uuid

    root = shared_folder(spark)
    return f"{root.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and the planner knows its size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 1_000_000) -> DataFrame:
    """df dealt by keys to so many places that each gets about `rows` rows: what a task holds doesn't grow with the table."""
    places = max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(places, *keys)


def stream_result(df: DataFrame) -> DataFrame:
    """What a streaming aggregate has once its present input is read: the last complete table, written by foreachBatch."""
    spark = df.sparkSession
    path = shared_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    query = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")
