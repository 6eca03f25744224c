"""Spark helpers that the operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`; where that is unset, a folder of our own, in local mode only."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_corvane_folder", None):
        sc._corvane_folder = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return sc._corvane_folder


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corvane/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that a task sends to Python while a table is written; 10,000 rows, Spark's bound, may be any size.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str, batch: str = "16m") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, no executor is needed for it.

    batch: about how large the batches become that go to Python meanwhile."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, batch)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files that `written` made."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


#: What a worker process keeps between tasks, by the operator it belongs to: a call that forgets it.
_KEPT: dict[str, Callable[[], None]] = {}


def kept_by(owner: str, forget: Callable[[], None]) -> None:
    """A module that keeps tables in worker processes says how to forget them."""
    _KEPT[owner] = forget


def begin_task(owner: str | None = None) -> None:
    """Workers are used again by other operators: forgets what any operator but `owner` keeps."""
    for name, forget in _KEPT.items():
        if name != owner:
            forget()


def end_task() -> None:
    """Gives freed memory back to the system, so that a worker's size is that of its present task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def arrow_task(run: Callable[[Iterator], Iterable], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """run as a task's function that begins and ends tidily."""

    def tidy(batches):
        begin_task(owner)
        try:
            yield from run(batches)
        finally:
            end_task()

    return tidy


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]], schema: T.StructType | str, owner: str | None = None) -> DataFrame:
    """mapInArrow with fn from a batch to column dicts or batches of the given schema; owner: whose kept tables it uses."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)
                yield out

    return df.mapInArrow(arrow_task(run, owner), struct)


def bernoulli(key: F.Column, share: float, seed: str) -> F.Column:
    """True for about `share` of all keys, always the same ones."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def remainder(doc_id: F.Column, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; that of the empty text for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int] | int, seed: str, usable: Callable[[F.Column], F.Column] | None = None) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and label (0 or 1) of about `most` labelled documents (in all or by label), chosen by a hash
    of the id, and how many there are of each label.

    The chosen ids number about `most` at any size of the tables, so they are broadcast. A document
    that has several labels takes the largest.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.filter(usable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for k, n in totals.items():
        share = min(1.0, (most[k] / n if isinstance(most, dict) else most / sum(totals.values())))
        chosen = chosen | ((F.col("label") == k) & bernoulli(F.col("doc_id"), share, seed))
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(known.filter(chosen)), "doc_id")
    return sample, totals
