"""A keyed Parquet table that is updated in place of being rewritten: deltas by bucket, versions, compaction where it pays.

The table is a folder. Each batch writes only its own rows, dealt to buckets by their key's hash, as one delta; a small
`versions` log says which base and deltas make up each bucket. So a batch that touches a hundredth of the keys writes
about a hundredth of the bytes. Reading merges by key, the latest version first. When a bucket's deltas hold more than
`slack` of its base, only that bucket is compacted into a new base; files of earlier versions stay until `clean`.

A batch has a number: one that is written again is found in the log and changes nothing. In a batch, the last row of a
key wins by `position`; a deleted key stays gone until a later batch brings it back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LOG = "version int, batch bigint, buckets array<struct<bucket:int,base:int,deltas:array<int>,rows:bigint,pending:bigint>>"


@dataclass(frozen=True)
class Bucket:
    """What a bucket consists of: the version of its base, those of its deltas, the rows in them."""

    base: int | None = None
    deltas: tuple[int, ...] = ()
    rows: int = 0
    pending: int = 0

    def files(self) -> list[int]:
        return [*([self.base] if self.base is not None else []), *self.deltas]

    def with_rows(self, version: int, n: int) -> Bucket:
        """With n rows of a batch: the first are the base, later ones a delta."""
        if not self.files():
            return Bucket(version, (), n)
        return Bucket(self.base, (*self.deltas, version), self.rows, self.pending + n)


@dataclass(frozen=True)
class KeyedTable:
    """key: the key column; buckets: how many parts its hash is dealt to, fixed when the table begins."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64
    slack: float = 0.5

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _last(self):
        """The last line of the log, None for a new table. A line is a batch, a few maps over the buckets."""
        jvm = self.spark.sparkContext._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not log.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
            return None
        return self.spark.read.schema(LOG).json(f"{self.path}/versions").orderBy(F.desc("version")).first()

    def done(self, batch: int) -> bool:
        return self._last() is not None and not self.spark.read.schema(LOG).json(f"{self.path}/versions").filter(F.col("batch") == batch).isEmpty()

    def _buckets(self) -> dict[int, Bucket]:
        last = self._last()
        return {x["bucket"]: Bucket(x["base"], tuple(x["deltas"]), x["rows"], x["pending"]) for x in last["buckets"]} if last else {}

    def read(self) -> DataFrame:
        """The present rows."""
        if self._last() is None:
            raise ValueError("the table has no batch yet")
        return self._merged(self._buckets()).filter("not _gone").drop("_gone", "_v", "_bucket")

    def _merged(self, buckets: dict[int, Bucket]) -> DataFrame:
        """The last version of each key; only files of the log are read."""
        files = [f"{self.path}/data/_v={v}/_bucket={b}" for b, x in buckets.items() for v in x.files()]
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(files or [f"{self.path}/data"]))
        w = W.partitionBy("_bucket", self.key).orderBy(F.desc("_v"))
        return (rows if files else rows.filter(F.lit(False))).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")

    def upsert(self, rows: DataFrame, batch: int, position: Column | None = None, gone: Column | None = None) -> dict[str, int]:
        """Puts rows in by key, and takes out keys whose row has `gone`; gives what was done: rows written and buckets compacted.
        Rows with a null key are left out."""
        if self.done(batch):
            return {"written": 0, "compacted": 0}
        last, buckets = self._last(), self._buckets()
        version = last["version"] + 1 if last else 0
        new = rows.filter(F.col(self.key).isNotNull()).withColumn("_gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        w = W.partitionBy(self.key).orderBy(position.desc() if position is not None else F.lit(1))
        new = new.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth").withColumn("_bucket", self._bucket())
        wrote = self._write(new, version)
        buckets |= {b: buckets.get(b, Bucket()).with_rows(version, n) for b, n in wrote.items()}
        full = {b: buckets[b] for b in wrote if buckets[b].pending > self.slack * buckets[b].rows}
        if full:
            version += 1  # beside the files that readers of the present version have open
            compact = self._write(self._merged(full).filter("not _gone").drop("_v"), version)
            buckets |= {b: Bucket(version, (), compact[b]) if b in compact else Bucket() for b in full}
        line = [(b, x.base, list(x.deltas), x.rows, x.pending) for b, x in sorted(buckets.items())]
        self.spark.createDataFrame([(version, batch, line)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return {"written": sum(wrote.values()), "compacted": len(full)}

    def _write(self, rows: DataFrame, version: int) -> dict[int, int]:
        """Writes rows as a version's files by bucket; the number of rows in each."""
        path = f"{self.path}/data/_v={version}"
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        try:
            counted = self.spark.read.parquet(path).groupBy("_bucket").agg(F.count("*").alias("n"))
        except Exception as e:  # nothing was written: there is no file to take a schema from
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return {}
        return {r["_bucket"]: r["n"] for r in counted.collect()}  # a row a bucket

    def clean(self) -> None:
        """Deletes files that the present version doesn't read."""
        keep = {v for x in self._buckets().values() for v in x.files()}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("_v=") and int(name[3:]) not in keep:
                fs.delete(s.getPath(), True)


def keyed_writer(table: KeyedTable, position: str | None = None, gone: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: each micro-batch is one batch of the table, so a batch that is run again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id, F.col(position) if position else None, F.col(gone) if gone else None)

    return write
