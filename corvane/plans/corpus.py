"""Queries of tables in documents, log sets and passages, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as K
from ..sources.sinks import dealt
from .knowledge import query
from .tables import table


def _in_order(rows, line) -> object:
    """Lines of a group in order of their number."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rows, line.alias("s")))), lambda p: p["s"]), "\n")


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), c AS (SELECT doc, count(*) AS n, string_agg(n || ',' || CAST(q AS INTEGER), ';' ORDER BY n) AS cells FROM l GROUP BY 1)
SELECT doc, 1 AS table_no, 1 AS start_line, CAST(3 + n AS INTEGER) AS end_line, 'line,quantity;' || cells AS cells FROM c UNION ALL SELECT doc, 2, CAST(4 + n AS INTEGER), CAST(7 + n AS INTEGER), 'all,;' || n || ',x|y' FROM c WHERE doc % 3 = 0""")
def prj20_document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with a table of their lines and, for every third, a second one with an escaped bar."""
    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").cast("int").alias("q"))
    g = li.groupBy("doc").agg(F.count("*").alias("k"), _in_order("n", F.format_string("| %d | %d |", "n", "q")).alias("rows"))  # an order's lines
    second = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("\n| all |\n|-----|---|\n| "), F.col("k").cast("string"), F.lit(" | x\\|y |"))).otherwise("")
    text = F.concat(F.lit("Lines\n| line | quantity |\n|:---|---:|\n"), F.col("rows"), F.lit("\n"), second, F.lit("\nend | of | it"))
    t = K.document_tables(g.select("doc", text.alias("text")), "doc", "text")
    return t.select("doc", "table_no", "start_line", "end_line", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'A;B|C;D' ELSE 'name;nation|' || s_name || ';<' || s_nationkey || '> & co' END AS cells FROM supplier""")
def prj18_html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as HTML tables; every second one's cells are filled again from four texts."""
    html = F.format_string("<table class='t'><tr><th>name<th> nation </tr>\n<TR><td><b>%s</b></td><td>&lt;%d&gt;\n &amp; co</td></table>", "s_name", "s_nationkey")
    rows = K.html_rows(html)
    texts = F.when(F.col("s_suppkey") % 2 == 0, F.array(*(F.lit(x) for x in "ABCD"))).otherwise(F.array(F.lit("one")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(K.refilled(rows, texts), lambda r: F.array_join(r, ";")), "|").alias("cells"))


@query("""WITH s AS (SELECT o_custkey AS stem, o_orderkey AS w, o_orderkey % 6 = 0 AS blank FROM orders),
a AS (SELECT l_orderkey AS w, l_returnflag <> 'N' AS filled, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT stem, count(*) AS segment_count, CASE min(w) % 2 WHEN 0 THEN 'normative' ELSE 'evidence' END AS layer FROM s GROUP BY 1),
q AS (SELECT stem, CAST(sum(n) AS BIGINT) AS total FROM s JOIN a USING (w) WHERE NOT blank AND filled GROUP BY 1), c AS (SELECT stem, count(*) AS chunk_count FROM s WHERE NOT blank AND w % 5 <> 0 GROUP BY 1)
SELECT 'stem ' || stem AS source_stem, total, segment_count, layer AS knowledge_layer, chunk_count FROM t LEFT JOIN q USING (stem) LEFT JOIN c USING (stem) WHERE total IS NOT NULL OR chunk_count IS NOT NULL""")
def log02_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as log files, orders as their segments, lines as questions on them."""
    o, w = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("segment "), c.cast("string")).alias("segment")
    seg = o.select(F.concat(F.lit("stem "), F.col("o_custkey").cast("string")).alias("source_stem"), w.alias("window_id"), name(w), F.when(w % 6 == 0, "  ").otherwise("text").alias("text"), F.when(w % 2 == 0, "normative").alias("knowledge_layer"), F.lit(0.0).alias("start_ts"), F.lit(1.0).alias("end_ts"))
    ans = table(spark, sf_dir, "lineitem").select(name(F.col("l_orderkey")), F.col("l_linenumber").alias("pos"), F.lit("what?").alias("question"), F.when(F.col("l_returnflag") != "N", "this").otherwise(" ").alias("answer"))
    qa, chunks = K.log_sets(seg, ans, o.select(name(w), F.when(w % 5 != 0, "summary").otherwise("").alias("summary")))
    both = qa.select("source_stem", "total", "segment_count", "knowledge_layer").join(chunks.select("source_stem", "chunk_count", F.col("knowledge_layer").alias("_layer")), "source_stem", "full")
    stems = seg.groupBy("source_stem").agg(F.count("*").alias("_n"))
    return both.join(stems, "source_stem").select("source_stem", "total", F.coalesce("segment_count", "_n").alias("segment_count"), F.coalesce("knowledge_layer", "_layer").alias("knowledge_layer"), "chunk_count")


@query("""WITH q AS (SELECT trim(text) || chr(10) || trim(a) AS document, 'qa' AS kind FROM (SELECT role, text, lead(text) OVER w AS a, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant' AND trim(text) <> '' AND trim(a) <> ''),
c AS (SELECT 'Doc ' || (doc_id % 5) || chr(10) || trim(text) AS document, 'semantic' AS kind FROM documents)
SELECT 'chunk-' || md5(document) AS hash_id, max(kind) AS kind, length(document) AS n_chars FROM (SELECT * FROM q UNION ALL SELECT * FROM c) GROUP BY document""")
def set02_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs and chunks as one set of passages; equal texts once."""
    from ..operators.docs import qa_pairs

    qa = qa_pairs(table(spark, sf_dir, "conversations")).select("question", "answer", F.create_map(F.lit("id"), "qa_id").alias("meta"))
    docs = table(spark, sf_dir, "documents").select(F.lit(" ").alias("title"), F.concat(F.lit("Doc "), (F.col("doc_id") % 5).cast("string")).alias("doc_name"), F.col("text").alias("content"), F.create_map(F.lit("id"), F.col("doc_id").cast("string")).alias("meta"))
    return K.passages(qa, docs).select("hash_id", "kind", F.length("document").cast("bigint").alias("n_chars"))
