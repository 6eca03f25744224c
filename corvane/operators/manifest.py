"""Assets, versions, keyed updates and change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

ASSET_FIELDS = (
    "asset_id", "asset_type", "knowledge_layer", "pipeline_stage", "status", "review_status", "source_path", "output_path", "parent_asset_id",
    "version", "created_at", "updated_at",
)

#: Lifecycle moves.
TRANSITIONS = {
    "draft": ("submitted",),
    "submitted": ("approved", "restricted", "needs_revision"),
    "needs_revision": ("submitted",),
    "approved": ("deprecated", "restricted"),
    "restricted": ("approved", "deprecated"),
    "deprecated": ("retired",),
    "retired": (),
}


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def assets(files: DataFrame, asset_type: str, stage: str, as_of: Column, layer: Column | None = None, parent_type: str | None = None) -> DataFrame:
    """Asset records of files (path, version[, parent_path]): identity from type and path, version from content."""
    parent = X.asset_id(F.lit(parent_type), F.col("parent_path")) if parent_type else F.lit(None).cast("string")
    return files.select(
        X.asset_id(F.lit(asset_type), F.col("path")).alias("asset_id"), F.lit(asset_type).alias("asset_type"),
        (layer if layer is not None else X.layer_of(F.col("path"))).alias("knowledge_layer"), F.lit(stage).alias("pipeline_stage"),
        F.lit("ready").alias("status"), F.lit("system_generated").alias("review_status"), F.col("path").alias("source_path"),
        parent.alias("parent_asset_id"), F.col("version"), as_of.alias("created_at"), as_of.alias("updated_at"),
    )


def union_assets(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def changed_records(current: DataFrame, log: DataFrame, position: Column) -> DataFrame:
    """The upsert events that the manifest log lacks: new assets and changed versions; the first created_at stays."""
    last = latest(log, ["asset_id"], [position.desc()])
    prev = last.select("asset_id", F.col("version").alias("_version"), F.col("created_at").alias("_created"), F.col("manifest_op").alias("_op"))
    joined = current.join(prev, "asset_id", "left")
    changed = joined.filter(~F.col("version").eqNullSafe(F.col("_version")) | (F.col("_op") == "delete"))
    return changed.withColumn("created_at", F.coalesce("_created", "created_at")).withColumn("manifest_op", F.lit("upsert")).drop("_version", "_created", "_op")


def current_view(log: DataFrame, position: Column) -> DataFrame:
    """The latest event of each asset, deleted ones left out."""
    return latest(log, ["asset_id"], [position.desc()]).filter(F.coalesce(F.col("manifest_op"), F.lit("upsert")) != "delete")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in by key; new rows replace old ones."""
    return rows.unionByName(table.join(rows.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def without_passages(table: DataFrame, texts: DataFrame, column: str = "document") -> DataFrame:
    """table without the rows whose text is exactly one of `texts`."""
    gone = texts.select(X.passage_id(F.col(column)).alias("_id")).distinct()
    return table.join(gone, X.passage_id(F.col(column)) == F.col("_id"), "left_anti")


def new_passages(passages: DataFrame, table: DataFrame, column: str = "document") -> DataFrame:
    have = table.select(X.passage_id(F.col(column)).alias("_id")).distinct()
    return passages.join(have, X.passage_id(F.col(column)) == F.col("_id"), "left_anti")


def back_fill(table: DataFrame, source: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """Columns filled from source where empty, or replaced wherever source has a value."""
    renamed = source.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    x = table.join(renamed, key, "left")
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    return x.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) if overwrite else F.coalesce(own(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def illegal_transitions(before: DataFrame, after: DataFrame, key: str = "name", status: str = "status") -> DataFrame:
    """Status changes between two snapshots that the lifecycle doesn't allow."""
    moves = before.select(key, F.col(status).alias("from")).join(after.select(key, F.col(status).alias("to")), key).filter(F.col("from") != F.col("to"))
    allowed = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)).cast("array<string>"))))
    return moves.filter(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("from")), F.col("to")), F.lit(False)))


def distinct_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """Adds `target`: the name, later equal ones with __dup1, __dup2 and so on before the suffix."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return names.withColumn("_n", n).withColumn("target", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("__dup"), F.col("_n").cast("string"), suffix))).drop("_n")


def phase0_plan(files: DataFrame) -> DataFrame:
    """(src, dst) of sorted copies: files right under a layer keep their name, those of a case folder get the folder's name in front."""
    parts = F.split("path", "/")
    layer, base = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    name = F.when(F.size(parts) > 2, F.concat(F.get(parts, F.lit(1)), base)).otherwise(base)
    x = files.select(F.col("path").alias("src"), layer.alias("layer"), name.alias("name"))
    return distinct_names(x.withColumn("_key", F.concat_ws("/", "layer", "name")), "_key", "src").select("src", F.col("target").alias("dst"), "layer")


def missing_layers(files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    spark = files.sparkSession
    have = files.select(F.get(F.split("path", "/"), F.lit(0)).alias("layer")).distinct()
    return spark.createDataFrame([(r,) for r in required], "layer string").join(have, "layer", "left_anti")


def inherited_metadata(rows: DataFrame, sources: list[tuple[DataFrame, str]], columns: list[str], defaults: dict[str, str]) -> DataFrame:
    """Each column from the first source that has it (in order, by the named key), else its default."""
    x = rows
    for k, (src, key) in enumerate(sources):
        x = x.join(latest(src, [key], [F.lit(1)]).select(key, *(F.col(c).alias(f"_{k}_{c}") for c in columns if c in src.columns)), key, "left")
    for c in columns:
        options = [F.nullif(F.col(f"_{k}_{c}"), F.lit("")) for k, (src, _) in enumerate(sources) if c in src.columns]
        x = x.withColumn(c, F.coalesce(*options, F.lit(defaults.get(c))))
    return x.drop(*(f"_{k}_{c}" for k, (src, _) in enumerate(sources) for c in columns if c in src.columns))
