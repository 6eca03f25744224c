"""Queries of template match and reference match, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import docs as D
from ..operators import templates as TM
from .knowledge import query
from .tables import table

#: Every fiftieth order stands for a template, the others for requests; the brands of their parts are the intents.
_INTENTS = """x AS (SELECT DISTINCT l_orderkey AS id, p_brand AS intent FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT id AS request_id, intent FROM x WHERE id % 50 <> 0), t AS (SELECT id AS template_id, intent FROM x WHERE id % 50 = 0),
w AS (SELECT intent, CAST(floor(1000000 * (1 + ln((SELECT count(DISTINCT template_id) FROM t) / count(*)))) AS BIGINT) AS w FROM t GROUP BY 1),
a AS (SELECT request_id, intent, coalesce(w, (SELECT CAST(floor(1000000 * (1 + ln(count(DISTINCT template_id)))) AS BIGINT) FROM t)) AS w FROM r LEFT JOIN w USING (intent)),
o AS (SELECT request_id, sum(w) AS total FROM a GROUP BY 1), z AS (SELECT template_id, sum(w) AS size FROM t JOIN w USING (intent) GROUP BY 1),
s AS (SELECT request_id, template_id, sum(w) AS shared FROM a JOIN t USING (intent) GROUP BY 1, 2),
c AS (SELECT request_id, template_id, CAST(floor(1000000 * shared::DOUBLE / (total + size - shared)::DOUBLE) AS BIGINT) AS score FROM s JOIN o USING (request_id) JOIN z USING (template_id)),
m AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, template_id) AS INTEGER) AS rank, template_id, score FROM c QUALIFY rank <= 3)"""


def _intents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("intent"))
    return x.filter("id % 50 <> 0").withColumnRenamed("id", "request_id"), x.filter("id % 50 = 0").withColumnRenamed("id", "template_id")


@query(f"WITH {_INTENTS} SELECT * FROM m")
def lim02_template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.match_templates(*_intents(spark, sf_dir))


@query(f"""WITH {_INTENTS} SELECT o.request_id, b.template_id, b.score / 1000000 AS score, CASE WHEN b.score >= 800000 THEN 'shortcut' WHEN b.score >= 500000 THEN 'hint' ELSE 'none' END AS band
FROM o LEFT JOIN (SELECT * FROM m WHERE rank = 1 AND score >= 500000) b USING (request_id)""")
def chk04_template_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.band_requests(*_intents(spark, sf_dir))


#: Names of one to nine characters: prefixes of part names and their initials.
_NAMES = """k AS (SELECT DISTINCT unnest([substr(p_name, 1, 1 + p_partkey % 9), upper(substr(p_name, 1, 1)), substr(p_name, 2, 2)]) AS doc_name FROM part WHERE p_partkey % 3 = 0),
r AS (SELECT DISTINCT unnest([p_name || ' ' || p_type, substr(p_name, 1, 3), ' ' || substr(p_name, 3, 1) || ' ', replace(p_name, ' ', '')]) AS ref FROM part WHERE p_partkey % 5 = 0)"""


@query(f"""WITH {_NAMES}, n AS (SELECT doc_name, lower(doc_name) AS b, regexp_replace(lower(doc_name), '\\s+', '', 'g') AS c FROM k), q AS (SELECT ref, lower(ref) AS a, regexp_replace(lower(ref), '\\s+', '', 'g') AS d FROM r),
m AS (SELECT ref, doc_name, CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 2 WHEN contains(d, c) OR contains(c, d) THEN 3 END AS level FROM q, n WHERE c <> '' AND d <> '')
SELECT ref, doc_name, level FROM m WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY level, length(doc_name) DESC, doc_name) = 1""")
def jn11_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References matched to names of any length, single characters too."""
    p = table(spark, sf_dir, "part")
    cutting = F.expr("substr(p_name, 1, 1 + cast(p_partkey % 9 as int))")
    known = p.filter("p_partkey % 3 = 0").select(F.explode(F.array(cutting, F.upper(F.substr("p_name", F.lit(1), F.lit(1))), F.substr("p_name", F.lit(2), F.lit(2)))).alias("doc_name"))
    refs = p.filter("p_partkey % 5 = 0").select(F.explode(F.array(F.concat_ws(" ", "p_name", "p_type"), F.substr("p_name", F.lit(1), F.lit(3)), F.concat(F.lit(" "), F.substr("p_name", F.lit(3), F.lit(1)), F.lit(" ")), F.replace("p_name", F.lit(" "), F.lit("")))).alias("ref"))
    return D.match_references(refs, known)
