import random

from pyspark.sql import functions as F

from corvane.functions import udf as U
from corvane.operators import docs as D
from corvane.operators import manifest as M


def sections(spark, text):
    return [(r.title, r.level, r.content) for r in D.sections(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("section_index").collect()]


def test_plain_sections(spark):
    assert sections(spark, "no heading") == [("Introduction", 1, "no heading")]
    assert sections(spark, "# a\n# b\nx\n## c") == [("b", 1, "x"), ("c", 2, "")]


def test_numbered_sections(spark):
    assert sections(spark, "# other\n# 1. one\nx\n# sub\ny") == [("Introduction", 1, "# other"), ("1. one", 1, "x\n# sub\ny")] or sections(spark, "# other\n# 1. one\nx\n# sub\ny")[1] == ("1. one", 1, "x\n# sub\ny")


def test_chunks_by_section_length(spark):
    docs = spark.createDataFrame([(n, "# t\n" + "\n\n".join(["w" * 999] * (n // 1000)) + "q" * (n % 1000 - 1 if n > 9000 else n % 1000 - 9)) for n in (5999, 12001)], "k int, t string")
    out = D.section_chunks(D.sections(docs, "k", "t"), "k")
    rows = {k: [r for r in out.collect() if r.k == k] for k in (5999, 12001)}
    assert len(rows[5999]) == 1 and len(rows[12001]) > 1
    assert all("(续" in r.content for r in rows[12001] if r.sub_index)


def test_edges_in_three_formats(spark):
    t = spark.createDataFrame([('{"a":["b","c"]}',), ('[{"a":"b"},{"d":"e"}]',), ('{"x":"y"}\n{"x":"z"}',)], "value string")
    assert {(r.src, r.dst) for r in D.read_edges(t).collect()} == {("a", "b"), ("a", "c"), ("d", "e"), ("x", "y"), ("x", "z")}


def test_reference_matching(spark):
    refs = spark.createDataFrame([("User Guide",), ("user guide v2",), ("Us erGu ide",), ("nothing",)], "ref string")
    known = spark.createDataFrame([("user guide",), ("user",)], "doc_name string")
    got = {r.ref: (r.doc_name, r.level) for r in D.match_references(refs, known).collect()}
    assert got == {"User Guide": ("user guide", 1), "user guide v2": ("user guide", 2), "Us erGu ide": ("user guide", 3)}


def test_insert_references(spark):
    docs = spark.createDataFrame([("d", "See the User-Guide for more.")], "doc_name string, content string")
    links = spark.createDataFrame([("d", "user guide"), ("d", "absent")], "doc_name string, anchor_text string")
    text = D.insert_references(docs, links).first().content
    assert 'User-Guide [[DOC_REF name="user guide"]] for' in text and text.endswith('[[DOC_REF name="absent"]]')


def test_table_chunks(spark):
    t = spark.createDataFrame([("x/doc_table_2.csv", [["h1", "h2"], ["1", "2", "3"]]), ("e.csv", [])], "path string, rows array<array<string>>")
    r = {x.csv_name: x for x in D.table_chunks(t).collect()}
    assert (r["doc_table_2.csv"].row_count, r["doc_table_2.csv"].column_count, r["doc_table_2.csv"].table_index) == (1, 3, 2)
    assert "(无表头)" in r["e.csv"].content


def test_image_chunks(spark):
    c = spark.createDataFrame([("d", "c1", "![](img/a.png)"), ("d", "c2", "![](b.png) ![](img/a.png)")], "doc_name string, chunk_id string, content string")
    i = spark.createDataFrame([("d", "img/a.png"), ("d", "other/b.png"), ("d", "unused.png")], "doc_name string, path string")
    assert {r.path: r.chunk_ids for r in D.image_chunks(c, i).collect()} == {"img/a.png": "c1,c2", "other/b.png": "c2"}


LOG = "asset_id string, version string, created_at string, manifest_op string, pos int"


def test_manifest_replay_is_a_no_op(spark):
    log = spark.createDataFrame([("a", "1", "t0", "upsert", 1), ("a", "2", "t0", "upsert", 2), ("b", "1", "t0", "upsert", 3), ("c", "1", "t0", "delete", 4)], LOG)
    now = spark.createDataFrame([("a", "2", "t9"), ("b", "5", "t9"), ("c", "1", "t9"), ("d", "1", "t9")], "asset_id string, version string, created_at string")
    new = M.changed_records(now, log, F.col("pos"))
    assert {(r.asset_id, r.created_at) for r in new.collect()} == {("b", "t0"), ("c", "t0"), ("d", "t9")}
    again = log.unionByName(new.withColumn("pos", F.lit(9)))
    assert M.changed_records(now, again, F.col("pos")).count() == 0
    assert {r.asset_id for r in M.current_view(log, F.col("pos")).collect()} == {"a", "b"}


def test_names_and_plan(spark):
    f = spark.createDataFrame([("normative/a.pdf",), ("evidence/case/a.log",), ("evidence/caseа/x.log",), ("evidence/case/b/a.log",)], "path string")
    p = {r.src: r.dst for r in M.phase0_plan(f).collect()}
    assert p["normative/a.pdf"] == "normative/a.pdf"
    assert sorted(v for k, v in p.items() if k.startswith("evidence/case/")) == ["evidence/casea.log", "evidence/casea__dup1.log"]
    assert [r.layer for r in M.missing_layers(f, ("normative", "memory_case")).collect()] == ["memory_case"]


def test_inherited_metadata(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    first, second = spark.createDataFrame([("a", "x"), ("b", "")], "k string, v string"), spark.createDataFrame([("b", "y")], "k string, v string")
    got = {r.k: r.v for r in M.inherited_metadata(rows, [(first, "k"), (second, "k")], ["v"], {"v": "z"}).collect()}
    assert got == {"a": "x", "b": "y", "c": "z"}


def test_chunks_are_cut_without_python(spark):
    """As the plain version cuts a text, for all sizes and line ends, and no batch of texts goes to Python."""
    r = random.Random(5)
    ends = ["\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\n## ", "\n# ", "\n### ", "## ", " "]
    texts = [None, "", "x"]
    for n in (0, 1, 14_999, 15_000, 15_001, 29_999, 30_000, 31_001, 79_999, 80_000, 100_001):
        for kinds in (ends, ends[:1], ends[1:6], ends[6:7], ends[7:9], [" "]):
            body = ""
            while len(body) < n:
                body += "é𝄞w" * r.choice((1, 30, 900, 9000)) + r.choice(kinds)
            texts.append(body[:n])
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = D.adaptive_chunks(docs, "k", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan
    found = {k: [] for k, _ in enumerate(texts)}
    for row in got.orderBy("k", "chunk_no").collect():
        found[row.k].append(row.chunk)
    assert found == {k: U.adaptive_chunks(t) if t else [] for k, t in enumerate(texts)}
