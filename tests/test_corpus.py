"""Tables in documents, processed documents, log sets, passages, asset records and rule tables."""

import base64
import json

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import assets as A
from corvane.operators import corpus as K
from corvane.operators import policies as PO

TEXT = """# Head
| a | b |
|---|:-:|
| 1 | x\\|y |
| 2 |
not a table
| lone | row |
```
| in | code |
|----|------|
```
  | c |
  | - |
end"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tables_of_a_document(spark):
    docs = spark.createDataFrame([(1, "Doc", TEXT), (2, "None", None), (3, "Empty", "")], "k int, doc_name string, t string")
    got = [(r.k, r.table_no, r.start_line, r.end_line, [list(x) for x in r.rows]) for r in K.document_tables(docs, "k", "t").orderBy("k", "table_no").collect()]
    assert got == [(1, 1, 1, 5, [["a", "b"], ["1", "x|y"], ["2", ""]]), (1, 2, 11, 13, [["c"]])]
    out = {r.k: r.t for r in K.replace_tables(docs, "k", "t").collect()}
    assert out[2] is None and out[3] == ""
    lines = out[1].split("\n")
    assert lines[0] == "# Head" and len(lines) == 10 and lines[-1] == "end" and "| in | code |" in lines
    assert [r.path for r in one(spark, X.table_refs(F.lit(out[1])))] == ["Doc_table_1.csv", "Doc_table_2.csv"]


def test_tables_are_found_without_a_shuffle(spark):
    texts = ["|a\n|-|\n|1\r\n |---|\nx\n|---|\n|---|\n```\n|a\n|-|", "```\n```\n|a|\n|:-:|\n|a|\n|b|\n", "|-|\n|a|\n|-|", " | q |  \n|-|-|\r\n```\n|x\n|-|\n```\n|y\n|-|", "a|b\n-|-"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = K.document_tables(docs, "k", "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.k, r.table_no, r.start_line, r.end_line, [list(x) for x in r.rows]) for r in found.orderBy("k", "table_no").collect()]
    want = [(0, 1, 0, 4, [[], []]), (0, 2, 5, 7, [["---"]]), (1, 1, 2, 6, [["a"], ["a"], ["b"]]), (3, 1, 0, 2, [["q"]]), (3, 2, 6, 8, [[]])]
    assert got == want


def test_html_rows_and_refill(spark):
    html = "<table><tr class='h'><th>a&amp;b<th>c</tr><TR><td>1<br>2</td></tr><tr><td> &lt;x&gt; </td><td>&nbsp;</td><td>z</td></table>"
    rows = K.html_rows(F.lit(html))
    assert one(spark, rows) == [["a&b", "c", ""], ["1 2", "", ""], ["<x>", "", "z"]]
    assert one(spark, K.refilled(rows, F.array(*(F.lit(x) for x in "ABCDE")))) == [["A", "B", ""], ["C", "", ""], ["D", "", "E"]]
    assert one(spark, K.refilled(rows, F.array(F.lit("A")))) == [["a&b", "c", ""], ["1 2", "", ""], ["<x>", "", "z"]]
    assert one(spark, K.html_rows(F.lit("no table"))) == []


def test_processed_documents(spark):
    image = base64.b64encode(b"\x89PNG" + b"x" * 1200).decode()
    content = f'# One\ntext ![p](data:image/png;base64,{image})\n| a |\n|---|\n| 1 |\n# Two\n[[DOC_REF name="Other"]]'
    docs = spark.createDataFrame([("D", "source_file/D.md", content), ("N", "source_file/N.md", None)], "doc_name string, path string, content string")
    rows = {r.doc_name: r for r in K.processed_documents(docs, F.lit("2025-01-01")).collect()}
    d = rows["D"]
    assert d.images == ["D_image_1.png"] and "![](D_image_1.png)" in d.full_text and "base64" not in d.full_text
    assert [s.title for s in d.sections] == ["One", "Two"] and d.references == ["Other"] and [list(t.rows) for t in d.tables] == [[["a"], ["1"]]]
    assert (d.metadata.image_count, d.metadata.section_count, d.metadata.reference_count, d.metadata.table_file_count) == (1, 2, 1, 1)
    assert rows["N"].full_text == "" and rows["N"].metadata.table_file_count == 0
    assert [r.doc_name for r in K.known_documents(K.processed_documents(docs, F.lit("x"))).orderBy("doc_name").collect()] == ["D", "N"]


def test_log_sets_and_passages(spark):
    seg = spark.createDataFrame([("s", 1, "s1", "text", None, 0.0, 1.0), ("s", 2, "s2", "more", "memory_case", 2.0, 3.0), ("s", 3, "s3", " ", "x", 4.0, 5.0), ("t", 1, "t1", "text", "normative", 0.0, 1.0)], "source_stem string, window_id int, segment string, text string, knowledge_layer string, start_ts double, end_ts double")
    ans = spark.createDataFrame([("s2", 0, "q2", "a2"), ("s1", 1, " q1 ", "a1"), ("s1", 0, "q0", " "), ("s3", 0, "q3", "a3")], "segment string, pos int, question string, answer string")
    summ = spark.createDataFrame([("s1", "sum 1"), ("t1", ""), ("s3", "lost")], "segment string, summary string")
    qa, chunks = K.log_sets(seg, ans, summ)
    (q,) = qa.collect()
    assert (q.source_stem, q.total, q.segment_count, q.knowledge_layer, [p.question for p in q.qa_pairs]) == ("s", 2, 3, "evidence", ["q1", "q2"])
    (c,) = chunks.collect()
    assert (c.source_stem, c.chunk_count, [(x.chunk_id, x.content) for x in c.chunks]) == ("s", 1, [("s_log_window_1", "sum 1")])
    pairs = spark.createDataFrame([("q", "a", {"n": "1"}), ("q", "a", {"n": "2"}), (" ", "", {})], "question string, answer string, meta map<string,string>")
    parts = spark.createDataFrame([("", "Doc", "body", {"s": "1"}), ("q", "Doc", "a", {"s": "2"})], "title string, doc_name string, content string, meta map<string,string>")
    got = {r.document: (r.kind, json.loads(r.meta)) for r in K.passages(pairs, parts).collect()}
    assert got == {"q\na": ("semantic", {"s": "2"}), "Doc\nbody": ("semantic", {"s": "1"})}


def test_scans_of_images_and_reports(spark, tmp_path):
    images = tmp_path / "images"
    for name, body in (("d1/a.PNG", b"\x89PNG\r\n\x1a\nx"), ("d1/b.txt", b"x"), ("d2/c.jpg", b"\xff\xd8\xffx"), ("d2/deep/e.png", b"x")):
        (images / name).parent.mkdir(parents=True, exist_ok=True)
        (images / name).write_bytes(body)
    got = sorted((r.relative_path, r.media_type, base64.b64decode(r.base64)[:1]) for r in K.read_images(spark, str(images)).collect())
    assert got == [("d1/a.PNG", "image/png", b"\x89"), ("d2/c.jpg", "image/jpeg", b"\xff")]
    reports = tmp_path / "ci"
    reports.mkdir()
    for name, body in (("ci_1.json", '{"asset_name": "a",\n "score": 1}'), ("ci_2.json", '{"asset_name": "a", "score": 2}'), ("ci_3.json", "{broken"), ("ci_4.json", '{"score": 9}'), ("other.json", '{"asset_name": "z"}')):
        (reports / name).write_text(body)
    assert [(r.asset_name, r.score) for r in K.read_ci_reports(spark, str(reports)).collect()] == [("a", 2.0)]
    files = spark.createDataFrame([("a.log",), ("ab.log",)], "name string")
    assert K.named(files, exact="a.log").count() == 1 and K.named(files, part="b").count() == 1 and K.named(files).count() == 2
    ranked = spark.createDataFrame([("b", "L1"), ("a", "L3"), ("c", None), ("d", "L3")], "name string, risk string")
    assert [r.name for r in K.by_severity(ranked, "risk", "name").collect()] == ["a", "d", "b", "c"]


def test_asset_records_of_odd_files(spark):
    rows = [
        ("source_file/x/.hidden", "v", 1, None), ("source_file/noext", "v", 1, None), ("processed_data/markdown/sub/a_processed.json", "v", 1, "{}"),
        ("processed_data/markdown/a_processed.json", "v", 1, "not json"), ("processed_data/log_cache/structured/l.jsonl", "v", 7, '{"stats": {"record_count": 5}, "created_at": "c", "is_source_of_truth": false}'),
        ("processed_data/semantic_chunk/d_for_chunking.json", "v", 1, '{"document_metadata": {"source_type": "table_csv", "source_path": "p.csv", "chunk_count": 3}}'), ("other/file", "v", 1, None),
    ]
    got = {r.storage_path: r for r in A.asset_records(spark.createDataFrame(rows, "path string, version string, size_bytes bigint, body string"), F.lit("now")).collect()}
    assert set(got) == {r[0] for r in rows} - {"other/file", "processed_data/markdown/sub/a_processed.json"}
    log = got["processed_data/log_cache/structured/l.jsonl"]
    assert (log.display_name, log.stats, log.created_at, log.updated_at, log.is_source_of_truth, log.parent_asset_id) == ("l", {"record_count": 5, "size_bytes": 7}, "c", "c", False, None)
    doc = got["processed_data/markdown/a_processed.json"]
    assert (doc.display_name, doc.knowledge_layer, doc.source_path, doc.parent_asset_id, doc.created_at) == ("a", "normative", "", None, "now")
    chunk = got["processed_data/semantic_chunk/d_for_chunking.json"]
    assert chunk.parent_asset_id.startswith("table_csv:") and chunk.stats["chunk_count"] == 3 and chunk.attributes == {"source_type": "table_csv"}
    assert got["source_file/noext"].attributes == {"suffix": ""} and got["source_file/x/.hidden"].attributes == {"suffix": ""}


def test_rule_tables(spark):
    d = spark.createDataFrame([("PASS",), ("PASS_WITH_WARNINGS",), ("REQUIRES_REVIEW",), ("REJECT",), ("?",), (None,)], "d string")
    assert [tuple(r) for r in d.select(PO.status_after(F.col("d")), PO.needs_note(F.col("d"))).collect()] == [("approved", False), ("approved", True), ("submitted", False), ("needs_revision", False), (None, False), (None, False)]
    caps = spark.createDataFrame([(1, True, True, None), (2, False, True, None), (3, False, False, 2), (4, None, None, 1), (5, False, False, None)], "id string, atomic boolean, whole_intent boolean, belongs_to_skill string")
    assert {(r.id, r.code) for r in PO.capability_findings(caps).collect()} == {("4", "unknown_parent"), ("5", "no_parent")}
    v = lambda s: one(spark, PO.version_key(F.lit(s)))
    assert v("1.9") < v("v1.10.0") and v("1.0.0") == v("1") and v("none") is None and v("0") == [0]
    body = json.dumps({"contract_id": "x", "repositories": {"one-repo": {}}, "primary_pipeline": [1, 2], "cross_repository_contracts": {}})
    rows = [("good", body, "abc file", "abc", "abc"), ("bad", body, "other", "abc", "zzz"), ("none", "[", None, "abc", None)]
    got = {(r.path, r.code, r.message) for r in PO.contract_findings(spark.createDataFrame(rows, "path string, body string, checksum string, digest string, peer string"), contract_id="x", canonical="c", repositories=("one-repo",), contracts=("lock",), required=("contract_id", "extra"), stages=2).collect()}
    common = {("missing_fields", "extra"), ("canonical_repository", ""), ("missing_contract", "lock")}
    assert got == {("good", *c) for c in common} | {("bad", *c) for c in common} | {("bad", "checksum", "abc"), ("bad", "peer_differs", "zzz"), ("none", "not_json", "")}
