"""Driver tables, and registries derived from them for the governance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Customers stand for skills, parts for tools; one table each, with all the columns that rules read.
STATUSES = ("approved", "draft", "restricted", "deprecated", "retired", "approved", "submitted", "bogus")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))
    return c.select(
        F.concat(F.lit("skill-"), k.cast("string")).alias("skill_name"), F.concat(F.lit("Works on "), F.lower("c_mktsegment"), F.lit(" data")).alias("purpose"),
        F.lit("team").alias("owner_team"), F.lit("1.0").alias("version"), pick(STATUSES, k).alias("status"), pick(("L0", "L1", "L2", "L3", "L4"), k).alias("risk_level"),
        F.lower("c_mktsegment").alias("bundle_scope"), pick(("passing", "pending", "failing"), k).alias("eval_status"), pick(("approved", "pending"), F.floor(k / 5)).alias("security_review"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd").alias("created_at"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.date_format(F.date_add(F.lit("2023-06-01").cast("date"), (k % 700).cast("int")), "yyyy-MM-dd")).alias("last_reviewed"),
        F.array(F.concat(F.lit("skill-"), (k + 7).cast("string"))).alias("dependencies"),
    )


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))
    called = F.filter(F.array(*(F.when(k % m != 0, F.concat(F.lit("skill-"), (k * m + 1).cast("string"))) for m in (2, 3, 5))), lambda x: x.isNotNull())
    return s.select(
        F.concat(F.lit("tool-"), k.cast("string")).alias("tool_name"), pick(("parsing", "validation", "cooking"), k).alias("category"), pick(("L0", "L1", "L2", "L3", "L4"), k + 1).alias("risk_level"),
        pick(("none", "read", "read", "write", "external", "read"), k + 1).alias("side_effects"), F.lit("team").alias("owner_team"), F.concat(F.lit("service-"), (k % 4).cast("string")).alias("service"),
        pick(STATUSES, k + 3).alias("status"), F.date_format(F.date_add(F.lit("2023-06-01").cast("date"), (k % 700).cast("int")), "yyyy-MM-dd").alias("last_reviewed"), called.alias("called_by_skills"),
    )


_S = "(['approved','draft','restricted','deprecated','retired','approved','submitted','bogus'])"

#: The same two registries for DuckDB, as common table expressions.
REGISTRY_SQL = f"""
skills AS (SELECT 'skill-' || c_custkey AS skill_name, 'Works on ' || lower(c_mktsegment) || ' data' AS purpose,
  {_S}[c_custkey % 8 + 1] AS status, (['L0','L1','L2','L3','L4'])[c_custkey % 5 + 1] AS risk_level, lower(c_mktsegment) AS bundle_scope,
  (['passing','pending','failing'])[c_custkey % 3 + 1] AS eval_status, (['approved','pending'])[(c_custkey // 5) % 2 + 1] AS security_review,
  DATE '2024-01-01' + CAST(c_custkey % 400 AS INTEGER) AS created_at,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE DATE '2023-06-01' + CAST(c_custkey % 700 AS INTEGER) END AS last_reviewed,
  'skill-' || (c_custkey + 7) AS dep FROM customer),
tools AS (SELECT 'tool-' || s_suppkey AS tool_name, (['parsing','validation','cooking'])[s_suppkey % 3 + 1] AS category,
  (['L0','L1','L2','L3','L4'])[(s_suppkey + 1) % 5 + 1] AS risk_level, (['none','read','read','write','external','read'])[(s_suppkey + 1) % 6 + 1] AS side_effects,
  'service-' || (s_suppkey % 4) AS service, {_S}[(s_suppkey + 3) % 8 + 1] AS status, DATE '2023-06-01' + CAST(s_suppkey % 700 AS INTEGER) AS last_reviewed,
  s_suppkey FROM supplier),
uses AS (SELECT t.tool_name, t.status AS tool_status, t.risk_level AS tool_risk, 'skill-' || (s_suppkey * m + 1) AS consumer
  FROM tools t, (SELECT unnest([2, 3, 5]) AS m) WHERE s_suppkey % m <> 0),
known AS (SELECT u.*, s.status AS skill_status, s.risk_level AS skill_risk, s.bundle_scope FROM uses u LEFT JOIN skills s ON s.skill_name = u.consumer)"""
AS_OF = "2025-03-01"
