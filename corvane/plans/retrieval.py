"""Queries of text search, vector search and their fusion, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import vectors as V
from .knowledge import query
from .tables import table

_BM25 = r"""f AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{3,}')) AS term FROM documents),
n AS (SELECT d.doc_id AS id, count(f.term) AS n FROM documents d LEFT JOIN f ON f.id = d.doc_id GROUP BY 1),
g AS (SELECT count(*) AS docs, avg(n) AS mean FROM n), tf AS (SELECT id, term, count(*) AS tf FROM f GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) AS term FROM benchmark),
w AS (SELECT tf.id, tf.term, CAST(floor(1000000 * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n.n / mean))) AS BIGINT) AS w
  FROM tf JOIN df USING (term) JOIN n ON n.id = tf.id, g WHERE tf.term IN (SELECT term FROM q)),
s AS (SELECT query_id, id, CAST(sum(w) AS BIGINT) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_BM25} SELECT query_id, rank, id, round(score / 100) AS score FROM t WHERE rank <= 10")
def search01_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that fit each benchmark passage best."""
    index = S.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = S.search(index, _questions(spark, sf_dir), 10)
    return found.select("query_id", "rank", "id", F.round(F.col("score") / 100).alias("score"))


_UNIT = """u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"""


@query(f"""WITH {_BM25}, {_UNIT}, c AS (SELECT b.item_id AS query_id, x.vec_id AS id, row_number() OVER (PARTITION BY b.item_id ORDER BY list_cosine_similarity(a.v, x.v) DESC, x.vec_id) AS rank FROM benchmark b JOIN u a ON a.vec_id = b.item_id, u x),
r AS (SELECT query_id, id, rank, 2 AS weight, 'text' AS source FROM t WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1, 'vector' FROM c WHERE rank <= 50),
z AS (SELECT query_id, id, CAST(sum(weight * (1000000000 // (rank + 60))) AS BIGINT) AS score, string_agg(source || ':' || rank, ' ' ORDER BY source) AS evidence FROM r GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, id, score, evidence FROM z WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""")
def search02_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases found by text and by vector: document and vector of one id are one case; text counts twice."""
    index = S.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = _questions(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    ivf = V.build_ivf(e, "vec_id", "embedding")
    by_vector = V.nearest_exact(ivf, asked.select("query_id").join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id"), 50)
    fused = S.fuse({"text": S.search(index, asked, 50), "vector": by_vector}, 10, weights={"text": 2})
    evidence = F.array_join(F.transform("evidence", lambda p: F.concat(p["source"], F.lit(":"), p["rank"].cast("string"))), " ")
    return fused.select("query_id", "rank", "id", "score", evidence.alias("evidence"))


def _asked(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"""WITH {_UNIT} SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, x.vec_id AS id, round_even(list_cosine_similarity(q.v, x.v), 6) AS score FROM u q, u x WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.vec_id) QUALIFY row_number() OVER w <= 10""")
def vec02_ivf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact ten nearest of every vector whose id is divisible by 20, by the cells that can hold them."""
    e = table(spark, sf_dir, "embeddings")
    return V.nearest_exact(V.build_ivf(e, "vec_id", "embedding"), _asked(e), 10).withColumn("score", F.bround("score", 6))


@query("SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(10 * count(*) AS BIGINT) AS wanted, true AS recalled FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def vec03_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What probing finds of the exact ten nearest: recalled is whether that is nine tenths or more. How many cells are probed is
    found with other rows as queries."""
    e = table(spark, sf_dir, "embeddings")
    index = V.build_ivf(e, "vec_id", "embedding")
    others = e.filter("vec_id % 20 = 10").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = V.probes_for(index, others, 10, 0.94)
    r = V.recall(V.probe(index, _asked(e), 10, probes), V.nearest_exact(index, _asked(e), 10))
    return r.agg(F.count("*").alias("n_queries"), F.sum("wanted").alias("wanted"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("recalled"))
