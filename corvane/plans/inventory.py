"""Queries of asset inventories, workbooks and logs from end to end, each with its DuckDB oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assets as A
from ..operators import policies as PO
from .knowledge import query
from .tables import table



def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that the tables stand for: documents with their processed forms, images of pages, question-answer sets of conversations,
    tables of suppliers with and without sidecars, windows of customers under indexes of every second nation, and files of no kind."""

    def files(name: str, path: Column, body: Column | None = None, where: str = "true") -> DataFrame:
        df = table(spark, sf_dir, name).filter(where)
        return df.select(path.alias("path"), F.sha1(path.cast("binary")).alias("version"), F.length(path).cast("bigint").alias("size_bytes"), (body if body is not None else F.lit(None).cast("string")).alias("body"))

    text = lambda c: F.col(c).cast("string")
    source = F.concat(F.lit("source_file/"), F.col("source"), F.lit("/"), text("doc_id"), F.lit(".md"))
    about = F.to_json(F.struct(F.struct(F.concat(F.lit("Doc "), text("doc_id")).alias("source"), source.alias("source_path"), (F.col("doc_id") % 7).alias("section_count"), F.lit("2025-02-02").alias("processed_at")).alias("metadata"), F.struct(F.when(F.col("doc_id") % 4 == 0, "memory_case").alias("knowledge_layer")).alias("asset_meta")))
    qa = F.to_json(F.struct(F.struct(F.concat(F.lit("d"), text("conv_id")).alias("source"), F.when(F.col("conv_id") % 3 == 0, "log_fault_segment").alias("source_type"), F.col("turn").alias("total")).alias("metadata")))
    side = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.lit("Sheet").alias("display_name"), F.lit(False).alias("is_source_of_truth"), F.lit("phase9").alias("pipeline_stage")))).otherwise("{broken")
    index = F.to_json(F.struct(F.lit("processed_data/log_cache/structured/x.jsonl").alias("source_jsonl"), F.array(F.struct(F.lit(1).alias("w")), F.struct(F.lit(2).alias("w"))).alias("fault_windows")))
    p = lambda folder, *parts: F.concat(F.lit(f"{folder}/"), *parts)
    parts = [
        files("documents", source), files("documents", p(A.MARKDOWN, F.lit("d"), text("doc_id"), F.lit("_processed.json")), about, "doc_id % 2 = 0"),
        files("pages", p(A.IMAGES, F.lit("d"), text("page_id"), F.lit("/p.PNG"))), files("conversations", p(A.QA, F.lit("c"), text("conv_id"), F.lit("_qa.json")), qa, "turn = 0"),
        files("conversations", p(A.QA, F.lit("c"), text("conv_id"), F.lit("_qa.metadata.json")), None, "turn = 0"), files("supplier", p(A.TABLES, F.lit("t"), text("s_suppkey"), F.lit(".csv")), side),
        files("nation", p(A.WINDOWS, F.lit("n"), text("n_nationkey"), F.lit("_fault_windows.json")), index, "n_nationkey % 2 = 0"),
        files("customer", p(A.WINDOWS, F.lit("n"), text("c_nationkey"), F.lit("_window_"), text("c_custkey"), F.lit(".jsonl"))),
    ]
    return reduce(DataFrame.unionByName, parts)


_KIND = lambda kind, path: f"'{kind}:' || substr(sha1('{kind}|' || {path}), 1, 24)"
_DOC = lambda k: f"'processed_data/markdown/d' || {k} || '_processed.json'"
_WIN = lambda k: f"'processed_data/log_cache/fault_windows/' || {k} || '_fault_windows.json'"


@query(f"""WITH a AS (
SELECT 'source_file' AS asset_type, 'source_file/' || source || '/' || doc_id || '.md' AS storage_path, 'normative' AS knowledge_layer, doc_id || '.md' AS display_name, 'phase0' AS pipeline_stage, true AS truth, NULL AS parent, length('source_file/' || source || '/' || doc_id || '.md') AS stat FROM documents
UNION ALL SELECT 'document_processed', {_DOC("doc_id")}, CASE WHEN doc_id % 4 = 0 THEN 'memory_case' ELSE 'normative' END, 'Doc ' || doc_id, 'phase1', true, {_KIND("source_file", "'source_file/' || source || '/' || doc_id || '.md'")}, doc_id % 7 FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'image_asset', 'processed_data/images/d' || page_id || '/p.PNG', 'derived_index', 'p.PNG', 'phase1', false, {_KIND("document_processed", _DOC("page_id"))}, length('processed_data/images/d' || page_id || '/p.PNG') FROM pages
UNION ALL SELECT 'qa_dataset', 'processed_data/qa_pair/c' || conv_id || '_qa.json', 'derived_index', 'd' || conv_id, 'phase2', false, CASE WHEN conv_id % 3 = 0 THEN {_KIND("log_fault_window_index", _WIN("'d' || conv_id"))} ELSE {_KIND("document_processed", _DOC("conv_id"))} END, turn FROM conversations WHERE turn = 0
UNION ALL SELECT 'table_csv', 'processed_data/table_cache/t' || s_suppkey || '.csv', 'evidence', CASE WHEN s_suppkey % 2 = 0 THEN 'Sheet' ELSE 't' || s_suppkey || '.csv' END, CASE WHEN s_suppkey % 2 = 0 THEN 'phase9' ELSE 'phase1' END, s_suppkey % 2 = 1, NULL, length('processed_data/table_cache/t' || s_suppkey || '.csv') FROM supplier
UNION ALL SELECT 'log_fault_window_index', {_WIN("'n' || n_nationkey")}, 'evidence', 'n' || n_nationkey, 'phase1', true, {_KIND("log_structured", "'processed_data/log_cache/structured/x.jsonl'")}, 2 FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'log_fault_window_segment', 'processed_data/log_cache/fault_windows/n' || c_nationkey || '_window_' || c_custkey || '.jsonl', 'evidence', 'n' || c_nationkey || '_window_' || c_custkey, 'phase1', true, CASE WHEN c_nationkey % 2 = 0 THEN {_KIND("log_fault_window_index", _WIN("'n' || c_nationkey"))} END, length('processed_data/log_cache/fault_windows/n' || c_nationkey || '_window_' || c_custkey || '.jsonl') FROM customer),
i AS (SELECT *, asset_type || ':' || substr(sha1(asset_type || '|' || storage_path), 1, 24) AS asset_id FROM a)
SELECT i.asset_id, asset_type, storage_path, knowledge_layer, display_name, pipeline_stage, truth, parent AS parent_asset_id, p.asset_id IS NOT NULL AS parent_found, CAST(stat AS BIGINT) AS stat FROM i LEFT JOIN (SELECT asset_id FROM i) p ON p.asset_id = i.parent""")
def man02_asset_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of eight kinds of files with their parents, and whether the parent is there."""
    r = A.linked(A.asset_records(_files(spark, sf_dir), F.lit("2025-01-01")))
    of = lambda n: F.try_element_at("stats", F.lit(n))
    return r.select("asset_id", "asset_type", "storage_path", "knowledge_layer", "display_name", "pipeline_stage", F.col("is_source_of_truth").alias("truth"), "parent_asset_id", "parent_found", F.coalesce(of("size_bytes"), of("section_count"), of("qa_count"), of("window_count")).alias("stat"))


@query("""WITH c AS (SELECT l_suppkey AS k, l_partkey % 7 AS s, l_linenumber % 3 AS t FROM lineitem WHERE l_suppkey % 5 < 4),
r AS (SELECT k, max(CASE s WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN t = 0 THEN 1 ELSE 3 END WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END WHEN 4 THEN CASE WHEN k % 10 = 3 THEN 4 ELSE 1 END ELSE 1 END) AS least FROM c WHERE NOT (s = 2 AND k % 3 > 0) GROUP BY 1)
SELECT 'skill ' || s_suppkey AS skill_name, 'L' || (s_suppkey % 4) AS risk_level, 'L' || least AS least_risk, coalesce(least > s_suppkey % 4, false) AS understated FROM supplier LEFT JOIN r ON k = s_suppkey""")
def rule_least_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as skills that call servers by the parts they deliver; a fifth of them calls nothing."""
    k, s = F.col("l_suppkey"), F.col("l_partkey") % 7
    server = F.when(s == 0, "device-status-mcp").when(s == 1, "knowledge-base-mcp").when(s == 2, "ticket-system-mcp").when((s == 3) & (k % 2 == 0), "notification-mcp").when((s == 4) & (k % 10 == 3), "verify-gate-mcp").otherwise("other")
    tool = F.when(F.col("l_linenumber") % 3 == 0, "get_work_order").otherwise("create_work_order")
    calls = table(spark, sf_dir, "lineitem").filter(k % 5 < 4).filter(~((s == 2) & (k % 3 > 0))).select(F.concat(F.lit("skill "), k.cast("string")).alias("skill_name"), server.alias("server"), tool.alias("tool"))
    skills = table(spark, sf_dir, "supplier").select(F.concat(F.lit("skill "), F.col("s_suppkey").cast("string")).alias("skill_name"), F.concat(F.lit("L"), (F.col("s_suppkey") % 4).cast("string")).alias("risk_level"))
    return PO.least_risk(calls, skills)


@query("""SELECT o_custkey AS run, CAST(min(CASE o_orderkey % 8 WHEN 0 THEN 4 WHEN 5 THEN 1 WHEN 4 THEN 2 ELSE 3 END) AS VARCHAR) AS layer,
  CASE min(CASE o_orderkey % 8 WHEN 0 THEN 4 WHEN 5 THEN 1 WHEN 4 THEN 2 ELSE 3 END) WHEN 4 THEN 'bpmn-xml-serializer' WHEN 1 THEN 'intent-parser' WHEN 2 THEN 'process-decomposer'
  ELSE string_agg(DISTINCT CASE o_orderkey % 8 WHEN 1 THEN 'bpmn-model-assembler' WHEN 2 THEN 'bpmn-task-classifier' WHEN 3 THEN 'bpmn-participant-organizer' END, ' ' ORDER BY CASE o_orderkey % 8 WHEN 1 THEN 'bpmn-model-assembler' WHEN 2 THEN 'bpmn-task-classifier' WHEN 3 THEN 'bpmn-participant-organizer' END) END AS steps
FROM orders WHERE o_orderkey % 8 < 6 GROUP BY 1""")
def chk06_steps_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs and their orders as errors, some of a class that isn't known."""
    classes = F.array(*(F.lit(c) for c in (*PO.GO_BACK, "other", "other")))
    errors = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.element_at(classes, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("error_class"))
    return PO.restart_layer(errors, "run").withColumn("steps", F.array_join("steps", " "))


@query("""SELECT user_id, 'event ' || event_type || ' took <*>.<*> at <*>' AS template, count(*) AS n, min(event_id) AS first, max(event_id) AS last, round_even(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS share FROM events GROUP BY user_id, event_type""")
def log03_template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    message = F.format_string("event %s took %s at '%s'", "event_type", F.format_string("%.2f", "value"), F.col("user_id").cast("string"))
    return PO.template_counts(e.select("user_id", "event_id", message.alias("message")), "message", "event_id", ("user_id",)).withColumn("share", F.bround("share", 9))


@query("""WITH a AS (SELECT DISTINCT l_partkey % 50 AS item, l_suppkey % 5 AS target, l_linenumber || '.' || (CAST(l_quantity AS INTEGER) % 12) AS version, l_linenumber AS x, CAST(l_quantity AS INTEGER) % 12 AS y FROM lineitem),
r AS (SELECT p_partkey AS rule_id, p_partkey % 50 AS item, p_size % 5 AS target, p_size % 4 AS lx, p_size % 11 AS ly, CASE WHEN p_size % 3 > 0 THEN p_size % 4 + 2 END AS hx, p_partkey % 2 = 0 AS works FROM part),
h AS (SELECT a.item, a.target, a.version, min_by(works, rule_id) AS works, min(rule_id) AS rule_id FROM a JOIN r USING (item, target) WHERE (x > lx OR x = lx AND y >= ly) AND (hx IS NULL OR x < hx OR x = hx AND y = 0) GROUP BY 1, 2, 3)
SELECT item, target, version, CASE WHEN works THEN 'compatible' WHEN NOT works THEN 'incompatible' ELSE 'unknown' END AS verdict, rule_id FROM a LEFT JOIN h USING (item, target, version)""")
def compat01_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions asked for by lines against ranges that parts stand for."""
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("item"), (F.col("l_suppkey") % 5).alias("target"), F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_quantity").cast("int") % 12).cast("string")).alias("version")).distinct()
    z = F.col("p_size")
    low = F.concat_ws(".", (z % 4).cast("string"), (z % 11).cast("string"))
    high = F.when(z % 3 > 0, F.concat((z % 4 + 2).cast("string"), F.lit(".0")))
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_partkey") % 50).alias("item"), (z % 5).cast("bigint").alias("target"), low.alias("low"), high.alias("high"), (F.col("p_partkey") % 2 == 0).alias("works"))
    return PO.compatibility(asked, rules)


@query("""WITH d AS (SELECT c_custkey AS k, c_custkey % 4 = 0 AS broken, c_custkey % 3 <> 0 AS named, c_custkey % 5 AS n, c_custkey % 7 = 0 AS lone FROM customer)
SELECT 'definition ' || k AS path, f.code, f.message FROM d, unnest([
  CASE WHEN broken THEN {'code': 'not_json', 'message': ''} END, CASE WHEN NOT broken AND NOT named THEN {'code': 'missing_fields', 'message': 'contract_id'} END, CASE WHEN NOT broken AND NOT named THEN {'code': 'contract_id', 'message': ''} END,
  CASE WHEN NOT broken AND lone THEN {'code': 'missing_repository', 'message': 'second'} END, CASE WHEN NOT broken AND n < 3 THEN {'code': 'short_pipeline', 'message': CAST(n AS VARCHAR)} END, CASE WHEN NOT broken AND k % 11 = 0 THEN {'code': 'no_checksum', 'message': ''} END]) AS t(f) WHERE f IS NOT NULL""")
def val_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as system definitions."""
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.when(k % 3 != 0, "system").alias("contract_id"), F.lit("first").alias("canonical_repository"), F.struct(F.struct(F.lit(1).alias("x")).alias("first"), F.when(k % 7 != 0, F.struct(F.lit(1).alias("x"))).alias("second")).alias("repositories"), F.expr("sequence(1, 9)").alias("_"), F.slice(F.expr("sequence(1, 9)"), F.lit(1), (k % 5).cast("int")).alias("primary_pipeline")))
    d = table(spark, sf_dir, "customer").select(F.concat(F.lit("definition "), k.cast("string")).alias("path"), F.when(k % 4 == 0, F.concat(F.lit("{"), k.cast("string"))).otherwise(body).alias("body"), F.when(k % 11 != 0, "abc  definition.json").alias("checksum"), F.lit("abc").alias("digest"), F.lit(None).cast("string").alias("peer"))
    return PO.contract_findings(d, contract_id="system", canonical="first", repositories=("first", "second"), contracts=(), required=("contract_id", "repositories", "primary_pipeline"), stages=3)
