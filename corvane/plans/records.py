"""Queries of names, placeholders, versions and small rules over the driver tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import docs as D
from ..operators import manifest as M
from ..operators import rules as R
from ..sources.sinks import dealt
from .knowledge import query
from .tables import REGISTRY_SQL, skills, table, tools


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


_SHEET = "CASE WHEN p_partkey % 9 = 0 THEN '#?' ELSE ' ' || p_name || '/' || p_partkey || '#' END"


@query(f"SELECT p_partkey, coalesce(nullif(trim(regexp_replace({_SHEET}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_'), ''), 'sheet') AS sheet FROM part")
def prj09_safe_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") % 9 == 0, "#?").otherwise(_text(" ", F.col("p_name"), "/", F.col("k"), "#"))
    return _part(spark, sf_dir).select("p_partkey", X.safe_sheet(name).alias("sheet"))


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN ' <>. ' ELSE repeat('a:b  <' || p_name || '>__', p_partkey % 12 + 1) END AS x FROM part),
s AS (SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(x, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g'), '_+', '_', 'g'), ' ._'), ''), 'unnamed') AS s FROM a)
SELECT p_partkey, CASE WHEN length(s) > 120 THEN rtrim(substr(s, 1, 110), ' ._') || '__' || substr(sha1(s), 1, 8) ELSE s END AS name FROM s""")
def prj10_safe_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("k") % 13 == 0, " <>. ").otherwise(F.repeat(_text("a:b  <", F.col("p_name"), ">__"), (F.col("k") % 12 + 1).cast("int")))
    return _part(spark, sf_dir).select("p_partkey", X.safe_file_name(name).alias("name"))


@query("""WITH a AS (SELECT page_id, './x\\' || replace(url, '/es/', '/./es\\\\') AS p, ' say "' || url || '"  twice ' AS r FROM pages)
SELECT page_id, array_to_string(list_transform(list_filter(string_split(replace(p, '\\', '/'), '/'), lambda p: p NOT IN ('', '.')), lambda p: trim(p)), '/') AS path, trim(regexp_replace(replace(r, '"', ''''), '\\s+', ' ', 'g')) AS ref FROM a""")
def prj11_normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("./x\\"), F.replace("url", F.lit("/es/"), F.lit("/./es\\\\")))
    ref = F.concat(F.lit(' say "'), "url", F.lit('"  twice '))
    return table(spark, sf_dir, "pages").select("page_id", X.normal_path(path).alias("path"), X.normal_ref(ref).alias("ref"))


#: A document with placeholders; {n} is the part's name, {k} its key, {m} its key modulo 3.
PLACED = 'a [[DOC_REF name=" {n} "]] b [[DOC_REF   name="{k}"]] c [[DOC_REF name="{n}"]] ![x](img/{k}.png) [[TABLE type="summary" summary="of {n}"]] ![]( ) [[TABLE type="file" summary="" path="t_{m}.csv"]] [[TABLE type="other" summary="x"]] ![y](/{n}/y.jpg)'
_PLACED_SQL = "replace(replace(replace('" + PLACED + "', '{n}', p_name), '{k}', CAST(p_partkey AS VARCHAR)), '{m}', CAST(p_partkey % 3 AS VARCHAR))"


def _placed() -> F.Column:
    filled = F.replace(F.replace(F.lit(PLACED), F.lit("{n}"), F.col("p_name")), F.lit("{k}"), F.col("k").cast("string"))
    return F.replace(filled, F.lit("{m}"), (F.col("k") % 3).cast("string"))


@query(f"""WITH a AS (SELECT p_partkey, {_PLACED_SQL} AS t FROM part),
r AS (SELECT p_partkey, list_transform(regexp_extract_all(t, '\\[\\[DOC_REF\\s+name="([^"]+)"\\s*\\]\\]', 1), lambda x: trim(x)) AS refs, t FROM a)
SELECT p_partkey, array_to_string(list_filter(refs, lambda x, i: x <> '' AND list_position(refs, x) = i), '|') AS docs, array_to_string(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), '|') AS images FROM r""")
def prj13_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _part(spark, sf_dir).withColumn("t", _placed())
    return x.select("p_partkey", F.array_join(X.doc_refs(F.col("t")), "|").alias("docs"), F.array_join(X.image_refs(F.col("t")), "|").alias("images"))


_TABLE = '\'\\[\\[TABLE\\s+type="(summary|file)"\\s+summary="([^"]*)"(?:\\s+path="([^"]*)")?\\s*\\]\\]\''


@query(f"""WITH a AS (SELECT p_partkey, {_PLACED_SQL} AS t FROM part), g AS (SELECT p_partkey, regexp_extract_all(t, {_TABLE}, 1) AS types, regexp_extract_all(t, {_TABLE}, 2) AS sums, regexp_extract_all(t, {_TABLE}, 3) AS paths FROM a),
i AS (SELECT *, unnest(generate_series(1, len(types))) AS i FROM g) SELECT p_partkey, types[i] AS type, sums[i] AS summary, coalesce(paths[i], '') AS path FROM i""")
def prj14_table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _part(spark, sf_dir).select("p_partkey", F.inline(X.table_refs(_placed())))
    return x.toDF("p_partkey", "type", "summary", "path")


@query("""WITH a AS (SELECT p_partkey, p_partkey % 4 AS n, p_partkey % 3 AS named FROM part)
SELECT p_partkey, CAST(n AS INTEGER) AS n_images, 'start' || array_to_string(list_transform(generate_series(1, n), lambda i: ' ' || CASE WHEN i <= named THEN '![](f' || i || '.png)' ELSE '' END || '.'), '') AS text FROM a""")
def prj16_embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with none to three images of 1200 bytes, for at most two of which there is a name; smaller ones aren't images."""
    blob = F.base64(F.substring(F.repeat(F.col("p_name"), 1200).cast("binary"), 1, 1200))  # as many bytes as 1600 characters of it stand for
    image = lambda _: F.concat(F.lit(" ![p](data:image/png;base64,"), F.substring(blob, 1, 1600), F.lit(")."))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i > 0)
    x = dealt(_part(spark, sf_dir), "p_partkey", rows=50_000)  # a small file of much work
    x = x.withColumn("t", F.concat(F.lit("start"), F.array_join(F.transform(upto(F.col("k") % 4), image), "")))
    names = F.transform(upto(F.col("k") % 3), lambda i: F.concat(F.lit("f"), i.cast("string"), F.lit(".png")))
    return x.select("p_partkey", F.size(X.embedded_images(F.col("t"))).alias("n_images"), X.replace_embedded(F.col("t"), names).alias("text"))


@query("SELECT event_id, '[' || CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%d') ELSE '' END || '] ' || event_type || ' ' || 'warn: ' || trim(' ' || props || ' ') AS line FROM events")
def prj26_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", X.log_line_text(day, F.col("event_type"), F.lit("warn"), F.concat(F.lit(" "), "props", F.lit(" "))).alias("line"))


@query("SELECT p_partkey, (p_size // greatest(gcd(p_size, p_partkey), 1)) || ':' || (p_partkey // greatest(gcd(p_size, p_partkey), 1)) AS ratio FROM part")
def prj34_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", X.ratio_text(F.col("p_size"), F.col("p_partkey")).alias("ratio"))


@query("""WITH l AS (SELECT o_custkey AS asset, o_orderkey AS pos, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT asset, pos FROM l WHERE n = 1 AND status <> 'P'""")
def upd02_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "P", "delete").when(F.col("o_orderstatus") == "F", "upsert")
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("pos"), op.alias("manifest_op"))
    return M.current_view(log, F.col("pos")).select(F.col("asset_id").alias("asset"), "pos")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 7 = 0 AND t.text = d.text)")
def set04_new_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return M.new_passages(d, d.filter("doc_id % 7 = 0"), "text").select("doc_id")


_LAYERS = ("normative", "evidence", "BUILDING", "memory_case")


@query("SELECT unnest(['normative', 'evidence', 'BUILDING', 'memory_case']) AS layer EXCEPT SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'evidence' END FROM customer")
def phase0_missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("evidence")
    return M.missing_layers(table(spark, sf_dir, "customer").select(F.concat(layer, F.lit("/x/"), F.col("c_custkey").cast("string")).alias("path")), _LAYERS)


@query("""WITH f AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'evidence/' ELSE 'evidence/case' || o_orderkey % 5 || '/' END || o_orderkey % 2 || '/n' || o_custkey || '.log' AS src, o_orderkey % 3 = 0 AS flat FROM orders GROUP BY ALL),
n AS (SELECT src, 'evidence/' || split_part(src, '/', 2) || split_part(src, '/', -1) AS key FROM f), d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src) - 1 AS k FROM n)
SELECT src, CASE WHEN k = 0 THEN key ELSE regexp_replace(key, '\\.log$', '') || '__dup' || k || '.log' END AS dst FROM d""")
def phase0_sorted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    folder = F.when(k % 3 == 0, "evidence/").otherwise(_text("evidence/case", k % 5, "/"))
    files = table(spark, sf_dir, "orders").select(_text(folder, k % 2, "/n", F.col("o_custkey"), ".log").alias("path")).distinct()
    return M.phase0_plan(files).select("src", "dst")


WORDS = ("查询余额", "资金 转账", "跨境资金划拨", "反洗钱", "", "销户申请")


@query("SELECT p_partkey, (['', 'L4', 'L5', 'L2', '', 'L4'])[p_partkey % 6 + 1] AS risk FROM part")
def rule_trigger_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*(F.lit(w) for w in WORDS)), (F.col("k") % len(WORDS) + 1).cast("int"))
    return _part(spark, sf_dir).select("p_partkey", F.coalesce(R.trigger_risk(text), F.lit("")).alias("risk"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_years(([1, 3, 5, 15])[o_custkey % 4 + 1]) AS DATE) AS until FROM orders WHERE o_custkey % 5 < 4
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_custkey % 5 = 4""")
def rule_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    kind = F.when(k % 5 == 4, "unheard-of").otherwise(F.element_at(F.array(*(F.lit(c) for c in R.RETENTION_YEARS)), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.keep_until(kind, F.col("o_orderdate").cast("date")).alias("until"))


@query("""WITH p AS (SELECT c_custkey AS k FROM customer), f AS (SELECT k, unnest(['R1','R2','R3','R4','R5','R6']) AS code FROM p)
SELECT 'process-' || k AS asset_name, code, CASE code WHEN 'R4' THEN 'WARNING' WHEN 'R3' THEN 'HIGH' WHEN 'R6' THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM f
WHERE CASE code WHEN 'R1' THEN k % 4 = 0 WHEN 'R2' THEN k % 2 = 0 AND k % 3 <> 0 WHEN 'R3' THEN k % 5 = 0 AND k % 2 = 1 WHEN 'R4' THEN k % 7 = 0 WHEN 'R5' THEN k % 3 = 0 AND k % 4 <> 1 ELSE k % 6 = 0 AND k % 4 = 2 END""")
def rule_regulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    maybe = lambda c: F.when(c, True)  # noqa: E731  a flag that isn't set is null
    x = table(spark, sf_dir, "customer").select(
        _text("process-", k).alias("name"), F.when(k % 4 > 0, "internal").when(k % 8 == 0, "").alias("data_class"), (k % 2 == 0).alias("customer_data"), maybe(k % 3 == 0).alias("consent"), (k % 5 == 0).alias("funds"),
        maybe(k % 2 == 0).alias("aml_step"), F.when(k % 7 > 0, 5).alias("retention"), maybe(k % 3 == 0).alias("cross_border"), maybe(k % 4 == 1).alias("approved"), (k % 6 == 0).alias("credit_decision"), F.when(k % 4 != 2, "said").alias("rationale"),
    )
    return R.regulatory(x).select("asset_name", "code", "severity")


@query(f"""WITH {REGISTRY_SQL}, b AS (SELECT skill_name, CAST(substr(skill_name, 7) AS BIGINT) AS k FROM skills), c AS (SELECT DISTINCT skill_name, k, unnest(['tool_' || (k % 150), 'no_such_' || (k % 10)]) AS call FROM b),
j AS (SELECT c.*, t.status FROM c LEFT JOIN tools t ON replace(t.tool_name, '-', '_') = c.call)
SELECT skill_name AS asset_name, 'unregistered_call' AS code, call AS message FROM j WHERE status IS NULL AND k % 6 <> 0 UNION ALL SELECT skill_name, 'inactive_call', call FROM j WHERE status IN ('deprecated', 'retired')""")
def rule_x1_inline_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("skill_name", 7, 20).cast("bigint")
    body = _text("first `svc-a:tool_", k % 150, "(x)` then svc-b:no_such_", k % 10, "(y), and again svc-a:tool_", k % 150, "(z)")
    bodies = skills(spark, sf_dir).select("skill_name", F.when(k % 6 == 0, "True").alias("meta_skill"), body.alias("body"))
    return R.inline_tool_calls(bodies, tools(spark, sf_dir)).select("asset_name", "code", "message")


@query(f"""WITH {REGISTRY_SQL}, f AS (SELECT 'tool-' || p_partkey AS tool_name, CASE WHEN p_partkey % 2 = 0 THEN 'parsing' END AS category, 'service-' || p_partkey % 4 AS service FROM part WHERE p_partkey % 3 < 2)
SELECT 'missing_in_fs' AS code, tool_name AS asset_name, '' AS message FROM tools ANTI JOIN f USING (tool_name) UNION ALL SELECT 'missing_in_registry', tool_name, '' FROM f ANTI JOIN tools USING (tool_name)
UNION ALL SELECT 'metadata_drift', tool_name, 'category' FROM f JOIN tools t USING (tool_name) WHERE coalesce(f.category, '') <> t.category""")
def rule_t1_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    found = table(spark, sf_dir, "part").filter(k % 3 < 2).select(_text("tool-", k).alias("tool_name"), F.when(k % 2 == 0, "parsing").alias("category"), _text("service-", k % 4).alias("service"))
    x = R.alignment(tools(spark, sf_dir), found, "tool", "tool_name", ["category", "service"])
    return x.select("code", "asset_name", F.when(F.col("code") == "metadata_drift", F.col("message")).otherwise("").alias("message"))


@query("""WITH r AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'Nation_' || c_nationkey WHEN 1 THEN 'see NATION_' || c_nationkey || ' now' ELSE 'the na tion_' || c_nationkey END AS ref FROM customer),
p AS (SELECT ref, n_name, CASE WHEN lower(ref) = lower(n_name) THEN 1 WHEN contains(lower(ref), lower(n_name)) OR contains(lower(n_name), lower(ref)) THEN 2
  WHEN contains(regexp_replace(lower(ref), '\\s+', '', 'g'), lower(n_name)) OR contains(lower(n_name), regexp_replace(lower(ref), '\\s+', '', 'g')) THEN 3 END AS level FROM r, nation)
SELECT ref, n_name AS doc_name, level FROM p WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY level, length(n_name) DESC, n_name) = 1""")
def jn11_ranked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    ref = F.when(k % 3 == 0, _text("Nation_", n)).when(k % 3 == 1, _text("see NATION_", n, " now")).otherwise(_text("the na tion_", n))
    return D.match_references(table(spark, sf_dir, "customer").select(ref.alias("ref")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_name")))


@query("""WITH c AS (SELECT doc_id, 'c' || doc_id AS chunk, 'img\\' || doc_id % 40 || '.png' AS ref FROM documents), i AS (SELECT DISTINCT p_size AS k, CASE WHEN p_size % 2 = 0 THEN './img/' ELSE 'other/' END || p_size || '.png' AS path FROM part),
m AS (SELECT i.path, c.chunk FROM i JOIN c ON i.k % 2 = 0 AND i.k = c.doc_id % 40 UNION ALL SELECT i.path, c.chunk FROM i JOIN c ON i.k % 2 = 1 AND i.k = c.doc_id % 40 AND c.doc_id % 3 = i.k % 3)
SELECT path, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunk_ids FROM m GROUP BY path""")
def jn12_image_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("doc_id"), F.col("p_size")
    chunks = table(spark, sf_dir, "documents").select(_text("d", k % 3).alias("doc_name"), _text("c", k).alias("chunk_id"), _text("text ![](img\\", k % 40, ".png) more").alias("content"))
    images = table(spark, sf_dir, "part").select(_text(F.when(s % 2 == 0, "./img/").otherwise("other/"), s, ".png").alias("path"), _text("d", s % 3).alias("doc_name")).distinct()
    return D.image_chunks(chunks, images)


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/jpeg' WHEN 5 THEN 'image/webp' ELSE 'image/png' END AS media_type FROM part")
def prj31_media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    heads = ("89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001", "474946383961000000000000", "524946460000000057454250", "00", "524946460000000000000000", "00")
    names = ("a.jpg", "a", "a.webp", "a.png", "x.JPEG", "y.webp", "z.bmp")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % 7 + 1).cast("int"))
    return _part(spark, sf_dir).select("p_partkey", X.media_type(F.unhex(pick(heads)), pick(names)).alias("media_type"))
