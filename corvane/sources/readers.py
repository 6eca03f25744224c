"""Scans: files, lines, CSV with encoding fallback, spreadsheets, JSON, sidecars, registries, front matter."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import udf as U
from ..operators.manifest import latest


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """name, path, size, modified; a missing folder has no files."""
    schema = "name string, path string, size bigint, modified timestamp"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.{log,txt}") -> DataFrame:
    """source_path, line_no, line in file order, from 0; bad bytes are replaced, a last line end begins no line.

    Files are read in splits, so one of any size fills many tasks: lines are numbered within each
    split, and the splits before it (a row each) say where a file's split begins.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    at = ["source_path", "_block"]
    x = lines.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_nth"), F.make_valid_utf8("value").alias("line"))
    blocks = x.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("source_path").orderBy("_block")) - F.col("_n")
    starts = blocks.withColumn("_from", before).select(*at, "_first", "_from")
    # Rows of one split follow one another in one task, so their ids do too.
    return x.join(starts, at).select("source_path", (F.col("_from") + F.col("_nth") - F.col("_first")).cast("int").alias("line_no"), "line")


def read_csv_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """path, encoding, rows."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.withColumn("t", U.csv_rows("content")).select("path", "t.encoding", "t.rows")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, rows of spreadsheets, cached values as text; needs openpyxl on the executors."""

    @F.udf("array<struct<sheet:string,rows:array<array<string>>>>")
    def sheets(content):
        import io

        import openpyxl

        book = openpyxl.load_workbook(io.BytesIO(bytes(content)), data_only=True, read_only=True)
        return [(s.title, [["" if c is None else str(c) for c in r] for r in s.iter_rows(values_only=True)]) for s in book.worksheets]

    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,xltx,xltm}").option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.explode(sheets("content")).alias("s")).select("path", "s.sheet", "s.rows")


def read_json_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files joined to the metadata of `<file>.asset_meta.json`."""
    side = sidecars.withColumn("path", F.regexp_replace("path", r"\.asset_meta\.json$", ""))
    return files.join(latest(side, ["path"], [F.lit(1)]), "path", "left")


def read_front_matter(spark: SparkSession, path: str, pattern: str = "SKILL.md") -> DataFrame:
    """path, fields, body of asset files outside hidden folders."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    x = df.select(F.col("_metadata.file_path").alias("path"), "value").filter(~F.col("path").rlike(r"/\.[^/]"))
    return x.withColumn("fm", U.front_matter("value")).select("path", "fm.fields", "fm.body")


_SCHEMA = "struct<type:string,required:array<string>,properties:map<string,struct<type:string,description:string>>>"
TOOL_DOCUMENT = (
    "tool_name string, display_name string, description string, category string, risk struct<level:string,side_effects:string,idempotent:boolean,requires_approval:boolean>, "
    f"ownership struct<team:string,service:string>, service string, called_by_skills array<string>, input_schema {_SCHEMA}, output_schema {_SCHEMA}, errors array<struct<code:string,message:string,retryable:boolean>>, "
    "usage struct<when_to_use:array<string>,called_by_skills:array<string>>, implementation struct<type:string,endpoint:string>"
)


def read_tool_documents(spark: SparkSession, path: str, pattern: str = "TOOL.md") -> DataFrame:
    """path and the keys of tool documents, nested ones as structs; an absent key, or one of another shape, is null. An empty file has no row."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    x = df.select(F.col("_metadata.file_path").alias("path"), F.from_json(U.tool_document("value"), TOOL_DOCUMENT).alias("t"))
    return x.select("path", "t.*")


def parse_registry(text: str, key: str) -> list[dict]:
    """Entries under a top-level key of a registry in YAML (scalars and flow or block lists of them)."""
    out: list[dict] = []
    inside, field = False, None
    for raw in text.splitlines():
        if not raw.strip() or raw.lstrip().startswith("#"):
            continue
        if re.match(r"\S", raw) and not raw.startswith("-"):
            inside = raw.split(":")[0].strip() == key
            continue
        if not inside:
            continue
        line = raw.strip()
        if (m := re.match(r"-\s+([\w-]+):\s*(.*)", line)) is not None:
            out.append({})
            line = f"{m[1]}: {m[2]}"
        elif line.startswith("- ") and out and field:
            held = out[-1].get(field)
            out[-1][field] = [*(held if isinstance(held, list) else []), _scalar(line[2:])]
            continue
        if out and (m := re.match(r"([\w-]+):\s*(.*)", line)) is not None:
            field = m[1]
            value = m[2].strip()
            out[-1][field] = [_scalar(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else _scalar(value)
    return out


def _scalar(s: str) -> str:
    s = re.sub(r"\s+#.*$", "", s.strip())
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


SKILL = "skill_name string, display_name string, purpose string, owner_team string, version string, status string, risk_level string, bundle_scope string, eval_status string, security_review string, path string, created_at string, last_reviewed string, dependencies array<string>, supported_models array<string>"
TOOL = "tool_name string, display_name string, version string, category string, risk_level string, side_effects string, owner_team string, service string, status string, path string, created_at string, last_reviewed string, idempotent boolean, called_by_skills array<string>"


def registry_table(spark: SparkSession, entries: list[dict], schema: str) -> DataFrame:
    """A registry (small by nature) as a table; absent fields are null, absent lists empty."""
    names = [(p.split()[0], p.split()[1]) for p in schema.split(", ")]

    def value(e: dict, name: str, kind: str):
        v = e.get(name)
        if kind.startswith("array"):
            return v if isinstance(v, list) else [] if v in (None, "") else [v]
        if kind == "boolean":
            return None if v is None else str(v).lower() in ("true", "yes", "1")
        return None if v is None else str(v)

    return spark.createDataFrame([tuple(value(e, n, k) for n, k in names) for e in entries], schema)
