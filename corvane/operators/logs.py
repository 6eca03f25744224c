"""Logs to fault windows: parsing, keep-latest, anchors, interval merging, membership, index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

#: Phrases that make a message a fault, and those that take it back.
FAULT_PHRASES = (
    "fail", "failed", "failure", "error", "err", "timeout", "time out", "reconnect", "exception", "abort", "fault", "reset",
    "错误", "失败", "异常", "故障", "超时", "rcvlen : 0", "rcvlen: 0", "rcvlen :0",
)
HARMLESS_PHRASES = (
    "open fail = 0", "open fail=0", "create success", "communication setup performance time", "getallserialcomfailednum null",
    "getprop persist.maxicharger.usbhuberrornum", "event_timeout_sounds", "timeoutmsounds", "erase timeout element", "totalerr=0",
    "workstatus=0", "reconnectupdata:0", "curstatus=0", "m_ccurtsta= 0",
)


def parse_logs(lines: DataFrame) -> DataFrame:
    """Records of (source_path, line_no, line): a blank or indented line continues the record before it."""
    x = lines.withColumn("hit", F.col("line").rlike(X.LOG_LINE))
    blank = F.trim(F.col("line")) == ""
    x = x.withColumn("goes_on", ~F.col("hit") & (blank | F.col("line").rlike(r"^[ \t]")))
    w = W.partitionBy("source_path").orderBy("line_no")
    x = x.withColumn("rid", F.sum((~F.col("goes_on")).cast("int")).over(w))
    # Before the first record a blank line is dropped and an indented one is a record of its own.
    lone = (F.col("rid") == 0) & ~blank
    x = x.filter(~((F.col("rid") == 0) & blank)).withColumn("rid", F.when(lone, -F.col("line_no") - 1).otherwise(F.col("rid")))
    fields = X.log_fields(F.col("line"))
    message = F.when(F.col("hit"), fields.pop("message")).when(F.col("goes_on"), F.col("line")).otherwise(F.trim("line"))
    x = x.select("source_path", "rid", "line_no", message.alias("message"), *(c.alias(k) for k, c in fields.items()))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "message")))
    out = x.groupBy("source_path", "rid").agg(
        F.min("line_no").alias("line_no"), *(F.max(k).alias(k) for k in ("ts", "module", "level", "tid")),
        F.trim(F.array_join(F.transform(pieces, lambda p: p["message"]), "\n"), F.lit(" \n\t")).alias("message"),
    )
    return out.select("source_path", "line_no", "ts", X.epoch_of(F.col("ts")).alias("ts_epoch"), "module", "level", "tid", "message")


def keep_latest(df: DataFrame, keys: list[str], epoch: Column, position: Column) -> DataFrame:
    """One row per key: the latest (no time counts as -1), of equally late ones the first."""
    w = W.partitionBy(*keys).orderBy(F.coalesce(epoch, F.lit(-1.0)).desc(), position.asc())
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def is_fault(message: Column, include=FAULT_PHRASES, exclude=HARMLESS_PHRASES, pattern: str = r"(?i)receive.*fail") -> Column:
    """A message with a fault phrase and without a harmless one."""
    low = F.lower(message)
    contains = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w.lower())) for w in words))
    return F.coalesce((F.trim(message) != "") & ~contains(exclude) & (contains(include) | message.rlike(pattern)), F.lit(False))


def windows(anchors: DataFrame, key: str, at: str, before: int, after: int, gap: int) -> DataFrame:
    """anchors with win_start, win_end and window_id (from 0 per key): padded intervals merge when the next begins
    at most `gap` after the end so far. `at` and the three lengths are whole numbers of one unit."""
    w = W.partitionBy(key).orderBy(at)
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    x = anchors.withColumn("_s", F.col(at) - before).withColumn("_e", F.col(at) + after)
    x = x.withColumn("_new", F.coalesce((F.col("_s") > F.max("_e").over(earlier) + gap).cast("int"), F.lit(1)))
    x = x.withColumn("window_id", (F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    return x.drop("_new").withColumnsRenamed({"_s": "win_start", "_e": "win_end"})


def fault_windows(anchors: DataFrame, key: str, at: str, message: str, before: int, after: int, gap: int, samples: int = 5) -> DataFrame:
    """A row per merged window: bounds, number of anchors, and the first distinct messages in order of time."""
    x = windows(anchors, key, at, before, after, gap)
    bounds = x.groupBy(key, "window_id").agg(F.min("win_start").alias("win_start"), F.max("win_end").alias("win_end"), F.count("*").alias("n_anchors"))
    # Each message by its first time, then the first few: a window's messages never come together in one row.
    text = F.substring(F.col(message), 1, 200).alias("_text")
    firsts = x.filter(F.col(message).isNotNull()).groupBy(key, "window_id", text).agg(F.min(F.struct(F.col(at).alias("at"), F.col(message).alias("m"))).alias("_first"))
    nth = F.row_number().over(W.partitionBy(key, "window_id").orderBy("_first"))
    kept = firsts.withColumn("_nth", nth).filter(F.col("_nth") <= samples).groupBy(key, "window_id").agg(F.array_sort(F.collect_list(F.struct("_nth", "_text"))).alias("_kept"))
    out = bounds.join(kept, [key, "window_id"], "left")
    return out.withColumn("samples", F.coalesce(F.transform("_kept", lambda p: p["_text"]), F.array().cast("array<string>"))).drop("_kept")


def window_members(records: DataFrame, wins: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Records within a window of their key, both ends included: an equi join on time bins that a window touches.

    Windows of one key don't overlap, so each record meets at most one.
    """
    bins = wins.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("win_start") / width), F.floor(F.col("win_end") / width))))
    rec = records.withColumn("_bin", F.floor(F.col(at) / width))
    return rec.join(bins.select(key, "_bin", "window_id", "win_start", "win_end"), [key, "_bin"]).filter(F.col(at).between(F.col("win_start"), F.col("win_end"))).drop("_bin")


def char_budget(lines: DataFrame, key: str, order: str, line: str, most_chars: int, most_lines: int) -> DataFrame:
    """The leading lines of each key up to a line count and a running length; the line that goes over is the last one kept."""
    w = W.partitionBy(key).orderBy(order)
    x = lines.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(F.length(line) + 1).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.filter((F.col("_n") <= most_lines) & (F.col("_sum") - F.length(line) - 1 <= most_chars)).drop("_n", "_sum")


def fault_index(windows_table: DataFrame) -> DataFrame:
    """Entries grouped by case_id and, separately, by device_sn; empty keys are left out."""
    entry = F.struct("source_stem", "fault_windows_file", "segments")
    parts = []
    for kind in ("case_id", "device_sn"):
        own = windows_table.filter(F.coalesce(F.col(kind), F.lit("")) != "")
        parts.append(own.groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("key")).agg(F.array_sort(F.collect_set(entry)).alias("entries")))
    return parts[0].unionByName(parts[1])


def index_jobs(index: DataFrame) -> DataFrame:
    """A row per segment of the index, listed once although two groupings name it."""
    flat = index.select("kind", "key", F.explode("entries").alias("e")).select("kind", "key", "e.*")
    w = W.partitionBy("fault_windows_file").orderBy("kind", "key")
    first = flat.withColumn("_n", F.dense_rank().over(w)).filter("_n = 1").drop("_n")
    return first.select("*", F.explode("segments").alias("segment")).dropDuplicates(["segment"])
