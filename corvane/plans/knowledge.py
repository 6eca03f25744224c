"""Queries of the knowledge-data side over the driver tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import docs as D
from ..operators import logs as L
from ..operators import manifest as M
from ..operators import similarity as S
from .tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


BEFORE, AFTER, GAP = (x * 1_000_000 for x in (7200, 14400, 7200))
_MERGED = f"""
a AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value FROM events WHERE event_type = 'error'),
w1 AS (SELECT *, us - {BEFORE} AS s, us + {AFTER} AS e FROM a),
w2 AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w1),
w3 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS window_id FROM w2),
wins AS (SELECT user_id, window_id, min(s) AS win_start, max(e) AS win_end, count(*) AS n_anchors FROM w3 GROUP BY user_id, window_id)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query(f"WITH {_MERGED} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, win_start, win_end, n_anchors FROM wins")
def win02_fault_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _events(spark, sf_dir).filter("event_type = 'error'").withColumn("message", F.col("event_type"))
    return L.fault_windows(a, "user_id", "us", "message", BEFORE, AFTER, GAP).drop("samples")


@query(f"""WITH {_MERGED} SELECT e.user_id, e.event_id, CAST(w.window_id AS INTEGER) AS window_id FROM events e
JOIN wins w ON w.user_id = e.user_id AND epoch_us(e.ts) BETWEEN w.win_start AND w.win_end""")
def jn09_window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    wins = L.fault_windows(e.filter("event_type = 'error'").withColumn("message", F.col("event_type")), "user_id", "us", "message", BEFORE, AFTER, GAP)
    return L.window_members(e, wins, "user_id", "us", 3600 * 1_000_000).select("user_id", "event_id", "window_id")


@query(f"""WITH {_MERGED}, m AS (SELECT user_id, window_id, us, CAST(value AS VARCHAR) AS v FROM w3)
SELECT user_id, CAST(window_id AS INTEGER) AS window_id, least(5, count(DISTINCT v)) AS n_distinct FROM m GROUP BY 1, 2""")
def agg18_window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _events(spark, sf_dir).filter("event_type = 'error'").withColumn("message", F.col("value").cast("string"))
    w = L.fault_windows(a, "user_id", "us", "message", BEFORE, AFTER, GAP)
    return w.select("user_id", "window_id", F.size("samples").cast("bigint").alias("n_distinct"))


@query(f"""WITH {_MERGED}, m AS (SELECT user_id, window_id, CAST(event_id % 7 AS VARCHAR) AS v, min(us) AS first_us FROM w3 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_id ORDER BY first_us, v) AS nth FROM m)
SELECT user_id, CAST(window_id AS INTEGER) AS window_id, string_agg('message ' || v, ', ' ORDER BY nth) AS samples FROM r WHERE nth <= 5 GROUP BY 1, 2""")
def agg18_sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five distinct messages of each window, in order of time."""
    message = F.concat(F.lit("message "), (F.col("event_id") % 7).cast("string")).alias("message")
    a = _events(spark, sf_dir).filter("event_type = 'error'").select("user_id", "us", message)
    w = L.fault_windows(a, "user_id", "us", "message", BEFORE, AFTER, GAP)
    return w.select("user_id", "window_id", F.array_join("samples", ", ").alias("samples"))


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def win01_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return L.keep_latest(e, ["user_id", "event_type"], F.col("us").cast("double"), F.col("event_id")).select("event_id", "user_id", "event_type", "value")


_INCLUDE, _EXCLUDE = ("error", "timeout", "thing", "über", "ción"), ("from the", "que la")


@query(
    "SELECT doc_id FROM documents WHERE trim(text) <> '' AND NOT ("
    + " OR ".join(f"contains(lower(text), '{w}')" for w in _EXCLUDE)
    + ") AND ("
    + " OR ".join(f"contains(lower(text), '{w}')" for w in _INCLUDE)
    + " OR regexp_matches(text, '(?i)receive.*fail'))"
)
def flt01_fault_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(L.is_fault(F.col("text"), _INCLUDE, _EXCLUDE)).select("doc_id")


@query("""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '<*>', 'g'), '"[^"]*"', '<*>', 'g'), '''[^'']*''', '<*>', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), 1, 500) AS template FROM documents""")
def prj05_message_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.message_template(F.col("text")).alias("template"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def src06_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(f"""WITH {_LINES}, m AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS n_chars FROM m WHERE line_no < 20 AND s - length(line) - 1 <= 1000 GROUP BY doc_id""")
def win04_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    kept = L.char_budget(lines, "doc_id", "line_no", "line", 1000, 20)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"""WITH {_LINES}, m AS (SELECT *, sum(CASE WHEN length(line) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS rid FROM l)
SELECT doc_id, CAST(rid AS BIGINT) AS rid, count(*) AS n FROM m GROUP BY 1, 2""")
def win03_record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    x = x.withColumn("rid", F.sum((F.length("line") > 200).cast("bigint")).over(W.partitionBy("doc_id").orderBy("line_no")))
    return x.groupBy("doc_id", "rid").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\\n([^\\n]{1,40})\\n', chr(10) || '# \\1' || chr(10), 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM t), c AS (SELECT *, bool_or(regexp_matches(line, '^#+\\s*\\d+\\.')) OVER (PARTITION BY doc_id) AS cases FROM l),
h AS (SELECT *, CASE WHEN cases THEN regexp_matches(line, '^#+\\s*\\d+\\.') ELSE starts_with(line, '#') END AS head FROM c),
s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS sid FROM h),
g AS (SELECT doc_id, sid, cases, max(CASE WHEN head THEN line END) AS heading, trim(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), ''), ' ' || chr(10) || chr(9)) AS content FROM s GROUP BY doc_id, sid, cases),
f AS (SELECT *, max(sid) OVER (PARTITION BY doc_id) = sid AS last FROM g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS INTEGER) AS section_index, coalesce(trim(regexp_replace(heading, '^#+', '')), 'Introduction') AS title,
  CAST(coalesce(length(regexp_extract(heading, '^(#+)', 1)), 1) AS INTEGER) AS level, CAST(length(content) AS INTEGER) AS n_chars FROM f WHERE content <> '' OR last OR cases""")
def prj24_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every line that ends a paragraph turned to a heading, cut to sections."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n([^\n]{1,40})\n", "\n# $1\n").alias("text"))
    return D.sections(d, "doc_id", "text").select("doc_id", "section_index", "title", "level", F.length("content").alias("n_chars"))


@query()
def chk10_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return D.section_chunks(D.sections(d, "doc_id", "text"), "doc_id").select("doc_id", "chunk_id", "section_index", "sub_index", "char_count")


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 0")
def chk12_qa_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks lose no character: their lengths add up to the document's."""
    c = D.adaptive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.sum(F.length("chunk")).alias("n_chars"))


_HREF = "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"


@query(f"SELECT DISTINCT page_id AS src, unnest({_HREF}) AS dst FROM pages")
def prj13_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("dst")).distinct()


@query(f"SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS targets FROM (SELECT page_id AS src, unnest({_HREF}) AS dst FROM pages) GROUP BY src")
def agg02_merged_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.consolidated(prj13_link_edges(spark, sf_dir)).select("src", F.array_join("targets", " ").alias("targets"))


_PAIRS = """p AS (SELECT conv_id, turn, trim(text) AS question, trim(a) AS answer FROM (SELECT *, lead(text) OVER w AS a, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND r = 'assistant' AND trim(text) <> '' AND trim(a) <> '')"""


@query(f"WITH {_PAIRS} SELECT conv_id, turn, 'qa_' || substr(sha1(conv_id || '||' || question || '||' || answer), 1, 24) AS qa_id, length(question) + length(answer) AS n_chars FROM p")
def hsh04_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = D.qa_pairs(table(spark, sf_dir, "conversations"))
    return q.select("conv_id", "turn", "qa_id", (F.length("question") + F.length("answer")).cast("bigint").alias("n_chars"))


@query(f"""WITH {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM p)
SELECT conv_id, count(*) AS n_pairs, md5(string_agg('## Q' || k || ': ' || question || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY k)) AS digest FROM n GROUP BY conv_id""")
def chk13_qa_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.qa_markdown(D.qa_pairs(table(spark, sf_dir, "conversations")), "conv_id").select("conv_id", "n_pairs", F.md5("markdown").alias("digest"))


_TOKENS = "t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}')) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id)"


@query(f"""WITH {_TOKENS}, s AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT s.a, s.b, s.shared, round_even(s.shared / (x.n + y.n - s.shared), 6) AS jaccard FROM s JOIN n x ON x.item_id = s.a JOIN n y ON y.item_id = s.b WHERE s.shared / (x.n + y.n - s.shared) > 0.05""")
def jn07_text_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.jaccard_pairs(table(spark, sf_dir, "benchmark"), "item_id", "text", 0.05)
    return p.select("a", "b", F.col("shared").cast("bigint").alias("shared"), F.bround("jaccard", 6).alias("jaccard"))


@query("""WITH n AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT p_name FROM part)
SELECT a.name AS candidate, b.name AS existing, levenshtein(a.name, b.name) AS distance FROM n a JOIN n b ON a.name <> b.name AND levenshtein(a.name, b.name) <= 4""")
def jn08_name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "part").select("p_name")).distinct()
    return S.near_names(n, n, "name", 4).withColumn("distance", F.col("distance").cast("bigint"))


@query("SELECT sha1(text) AS version, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def hsh02_exact_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("version"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT 'source_file:' || substr(sha1('source_file|' || source || '/' || doc_id || '.md'), 1, 24) AS asset_id, sha1(text) AS version, 'normative' AS knowledge_layer FROM documents")
def man01_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha1(F.col("text").cast("binary")).alias("version"))
    return M.assets(f, "source_file", "phase0", F.lit("2025-01-01")).select("asset_id", "version", "knowledge_layer")


@query("""WITH old AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CAST(o.o_orderkey AS VARCHAR) AS asset_id, o.o_orderstatus AS version, CASE WHEN old.k IS NULL THEN 'new' ELSE 'first' END AS created_at FROM orders o LEFT JOIN old ON old.k = o.o_orderkey WHERE old.v IS DISTINCT FROM o.o_orderstatus""")
def upd01_manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    now = o.select(F.col("o_orderkey").cast("string").alias("asset_id"), F.col("o_orderstatus").alias("version"), F.lit("new").alias("created_at"))
    log = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("asset_id"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("version"), F.lit("first").alias("created_at"), F.lit("upsert").alias("manifest_op"), F.lit(1).alias("pos"))
    return M.changed_records(now, log, F.col("pos")).select("asset_id", "version", "created_at")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upd03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return M.upsert(c.filter("k % 2 = 0").withColumn("v", F.lit("old")), c.filter("k % 3 = 0").withColumn("v", F.lit("new")), "k").select("k", "v")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0)")
def upd04_without_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.without_passages(d, d.filter("doc_id % 10 = 0").select("text"), "text").select("doc_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'own' END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def upd05_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("own").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return M.back_fill(s, n, "k", ["name"]).select("s_suppkey", "name")


@query("""WITH m AS (SELECT c_custkey AS k, (['draft','submitted','approved'])[c_custkey % 3 + 1] AS f, (['submitted','approved','deprecated','retired'])[c_custkey % 4 + 1] AS t FROM customer)
SELECT k AS name, f AS "from", t AS "to" FROM m WHERE f <> t AND NOT ((f = 'draft' AND t = 'submitted') OR (f = 'submitted' AND t IN ('approved', 'restricted', 'needs_revision')) OR (f = 'approved' AND t IN ('deprecated', 'restricted')))""")
def upd06_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    pick = lambda v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("name") % len(v) + 1).cast("int")).alias("status")
    return M.illegal_transitions(c.select("name", pick(("draft", "submitted", "approved"))), c.select("name", pick(("submitted", "approved", "deprecated", "retired"))))


@query("""SELECT p_partkey, CASE WHEN n = 0 THEN p_name || '.csv' ELSE p_name || '__dup' || n || '.csv' END AS target FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)""")
def upd07_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".csv")).alias("name"))
    return M.distinct_names(p, "name", "p_partkey").select("p_partkey", "target")


def _label_queries(e: DataFrame) -> DataFrame:
    return e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q")).select(F.col("q.vec_id").alias("query_id"), "q.embedding")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
SELECT query_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, e.v) DESC, e.vec_id) AS rank FROM q, e) WHERE rank <= 10""")
def vec01_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest to the first vector of each label."""
    e = table(spark, sf_dir, "embeddings")
    return S.nearest(_label_queries(e), e.select(F.col("vec_id").alias("id"), "embedding"), 10).select("query_id", "rank", "id")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)), s AS (SELECT q.vec_id AS query_id, list_cosine_similarity(q.v, e.v) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, e.v) DESC, e.vec_id) AS r FROM q, e)
SELECT query_id, count(*) FILTER (WHERE r <= 10 AND c >= 0.6) > 0 AS evidence, count(*) FILTER (WHERE r <= 10 AND c >= 0.6) AS n_sources FROM s GROUP BY 1""")
def gr13_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = _label_queries(e)
    a = S.answers(S.nearest(q, e.select(F.col("vec_id").alias("id"), "embedding"), 10), q, 0.6)
    return a.select("query_id", "evidence", F.coalesce(F.size("sources"), F.lit(0)).cast("bigint").alias("n_sources"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN p_name ELSE substr(p_name, 1, 8) || '…' END AS short FROM part")
def prj22_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.truncated(F.col("p_name"), 9).alias("short"))


@query("SELECT s_suppkey, regexp_extract(s_name, '^([^#]*)', 1) || '_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS stem FROM supplier")
def prj08_safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.safe_stem(F.regexp_replace("s_name", "#", "|")).alias("stem"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'memory_case' WHEN doc_id % 3 = 1 THEN 'normative' ELSE 'derived_index' END AS layer FROM documents")
def prj25_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.when(k % 3 == 0, "memory_case/a.log").when(k % 3 == 1, "other/b.PDF").otherwise("c.bin")
    return table(spark, sf_dir, "documents").select("doc_id", X.layer_of(path).alias("layer"))


@query("SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS ts_text FROM events")
def prj04_epoch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.date_format(F.timestamp_micros(F.floor(F.col("us") / 1000) * 1000), "yyyy-MM-dd HH:mm:ss.SSS").alias("ts_text"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch(date_trunc('second', ts)) + (CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 306 ELSE 0 END) / 1000 END AS ts_epoch FROM events")
def prj03_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    fraction = F.when(k == 0, ".3").when(k == 1, ".306").when(k == 2, "").otherwise(".123456")
    return table(spark, sf_dir, "events").select("event_id", X.epoch_of(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), fraction)).alias("ts_epoch"))


@query("SELECT o_orderkey, event_id FROM (SELECT o_orderkey, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM orders JOIN events ON user_id = o_custkey) WHERE n = 1")
def qry02_latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "events"), F.col("user_id") == F.col("o_custkey"))
    return M.latest(j, ["user_id"], [F.desc("ts"), F.col("event_id"), F.col("o_orderkey")]).select("o_orderkey", "event_id").filter("o_orderkey is not null")


ORACLES["qry02_latest_reading"] = "SELECT o_orderkey, event_id FROM (SELECT o_orderkey, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id, o_orderkey) AS n FROM orders JOIN events ON user_id = o_custkey) WHERE n = 1"


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def qry01_event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    end = table(spark, sf_dir, "events").agg(F.max("ts").alias("end"))
    return e.join(F.broadcast(end), F.col("ts") >= F.col("end") - F.expr("interval 7 days")).select("event_id", "user_id", "event_type")


@query("SELECT source AS category, count(*) AS n FROM documents GROUP BY 1")
def chk09_count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1, 2 HAVING count(*) >= 3")
def rule_recurring_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("end"))
    x = e.join(F.broadcast(end), F.col("ts") >= F.col("end") - F.expr("interval 30 days"))
    return x.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n >= 3")


@query("""SELECT user_id, event_id AS line_no, 'mod' || user_id AS module, event_type AS level, CAST(event_id AS VARCHAR) AS tid, 'value ' || value AS message FROM events""")
def prj01_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as log lines, one file per user, and parsed again."""
    e = table(spark, sf_dir, "events")
    line = F.format_string("1#:2:[%s]: mod%d :%s:3:tid:%d:value %s ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "user_id", F.upper("event_type"), "event_id", F.col("value").cast("string"))
    r = L.parse_logs(e.select(F.col("user_id").cast("string").alias("source_path"), F.col("event_id").alias("line_no"), line.alias("line")))
    return r.select(F.col("source_path").cast("bigint").alias("user_id"), "line_no", "module", "level", "tid", "message")


@query("""SELECT user_id, count(*) AS n_records, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_heads FROM (SELECT user_id, event_id, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS rid FROM events) WHERE event_id % 3 = 0 OR rid = 0 GROUP BY 1""")
def prj02_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three lines are indented: they continue the record before them, or stand alone before the first."""
    e = table(spark, sf_dir, "events")
    head = F.format_string("1#:2:[2024-01-01 00:00:00]:m:info:3:tid:%d:x", "event_id")
    line = F.when(F.col("event_id") % 3 == 0, head).otherwise(F.concat(F.lit("  more "), F.col("event_id").cast("string")))
    r = L.parse_logs(e.select(F.col("user_id").cast("string").alias("source_path"), F.col("event_id").alias("line_no"), line.alias("line")))
    return r.groupBy(F.col("source_path").cast("bigint").alias("user_id")).agg(F.count("*").alias("n_records"), F.count("module").alias("n_heads"))


@query("SELECT p_partkey, 'Case' || p_size AS case_key, CASE WHEN p_size % 2 = 0 THEN 'EVSHWT-' || p_size ELSE '' END AS case_id FROM part")
def prj06_case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size").cast("string")
    stem = F.concat(F.lit(" Case"), z, F.lit(" __"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("evshwt-"), z)).otherwise("x"))
    return table(spark, sf_dir, "part").select("p_partkey", X.case_key(stem).alias("case_key"), X.case_id(stem).alias("case_id"))


@query("SELECT page_id, replace(regexp_replace(url, '^https?://', ''), '//', '/') AS rel, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def prj12_relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", X.relative_path(F.concat(F.lit("/base/"), F.regexp_replace(bare, "//", "/")), "/base").alias("rel"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("SELECT p_partkey, p_name AS doc, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS nth FROM part")
def prj21_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(".csv"))).otherwise(F.concat("p_name", F.lit("_table_"), F.col("p_size").cast("string"), F.lit(".csv")))
    doc, nth = X.table_file(name)
    return table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"), nth.alias("nth"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'svc:do_' || s_suppkey || '()' END AS endpoint FROM supplier")
def prj27_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.endpoint_of(F.when(k % 2 == 0, "own").otherwise(""), F.lit("svc"), F.concat(F.lit("do-"), k.cast("string"))).alias("endpoint"))


@query("SELECT p_partkey, p_name AS question, CAST(p_size AS VARCHAR) AS answer, 'general' AS category FROM part WHERE p_size % 4 <> 0")
def prj28_model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as fenced JSON, bare JSON, or no JSON at all; items without an answer are dropped."""
    item = F.format_string('[{"question": " %s", "answer": "%d "}, {"question": "x", "answer": ""}]', "p_name", "p_size")
    z = F.col("p_size") % 4
    reply = F.when(z == 0, "sorry").when(z == 1, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(z == 2, F.concat(F.lit("here: "), item)).otherwise(item)
    q = table(spark, sf_dir, "part").select("p_partkey", F.explode(X.qa_items(reply)).alias("q"))
    return q.select("p_partkey", "q.question", "q.answer", "q.category")


@query("SELECT o_orderkey % 50 AS k, 'case_id' AS kind, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1 UNION ALL SELECT o_orderkey % 70, 'device_sn', count(DISTINCT o_orderkey) FROM orders GROUP BY 1")
def agg01_fault_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    w = table(spark, sf_dir, "orders").select(s(k).alias("source_stem"), s(k).alias("fault_windows_file"), F.array(s(k)).alias("segments"), F.when(F.col("o_custkey") % 3 != 0, s(k % 50)).otherwise("").alias("case_id"), s(k % 70).alias("device_sn"))
    return L.fault_index(w).select(F.col("key").cast("bigint").alias("k"), "kind", F.size("entries").cast("bigint").alias("n"))


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel FROM lineitem")
def ded01_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel")).dropDuplicates(["src", "dst", "rel"])


@query("SELECT c_custkey, n_name, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'side' ELSE 'none' END AS layer FROM customer JOIN nation ON n_nationkey = c_nationkey")
def jn10_inherited_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    own = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("own").alias("layer"))
    side = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("side").alias("layer"))
    return M.inherited_metadata(c, [(own, "c_custkey"), (side, "c_custkey")], ["layer"], {"layer": "none"})


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def qry03_optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.listing(table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")), equal={"o_orderstatus": "F", "c_mktsegment": None}, at="o_orderdate", since="1997-01-01").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, rank FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) WHERE rank <= 5")
def qry05_tagged_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.array_compact(F.array(F.when(k % 2 == 0, "even"), F.when(k % 3 == 0, "three"))).alias("tags"))
    best = D.with_tags(t, "tags", ["even", "three"]).orderBy("s_acctbal", "s_suppkey").limit(5)
    return best.withColumn("rank", F.row_number().over(W.orderBy("s_acctbal", "s_suppkey")).cast("bigint")).select("s_suppkey", "rank")


@query(f"WITH {_MERGED} SELECT user_id, win_start, win_end, n_anchors FROM wins")
def str03_fault_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form of fault windows, run over the whole table."""
    from ..streaming.streams import fault_sessions

    a = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    s = fault_sessions(a, "user_id", "ts", 7200, 14400, 7200)
    return s.select("user_id", F.unix_micros("win_start").alias("win_start"), F.unix_micros("win_end").alias("win_end"), "n_anchors")


@query("SELECT conv_id, CAST(max(turn) AS BIGINT) AS turn, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1")
def str04_keep_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as a stream of files; per conversation the number of turns and the last one, from the finished state."""
    from ..sources.sinks import stream_result

    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(spark, sf_dir, "conversations"))
    return stream_result(s.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("n")))


def _as_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The table in the shared folder as a folder of files, as a stream's source wants it."""
    from ..sources.sinks import shared_path

    path = shared_path(spark, name)
    table(spark, sf_dir, name).write.parquet(path)
    return path
