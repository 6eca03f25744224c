import json

from pyspark.sql import functions as F

from corvane.operators import admission, seams
from corvane.sources import readers, sinks
from corvane.streaming import streams


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo")
    (tmp_path / "b.bin").write_text("x")
    assert readers.list_files(spark, str(tmp_path / "none")).count() == 0
    assert readers.list_files(spark, str(tmp_path), "*.log").first().name == "a.log"
    assert [r.line for r in readers.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["one", "two"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    want = {}
    for name, n, end in (("a.log", 3000, "\n"), ("b.log", 2000, "\r\n"), ("c.txt", 1, ""), ("d.log", 0, "")):
        lines = [f"{name} {k} " + "é" * (k % 90) for k in range(n)]
        (tmp_path / name).write_bytes(end.join(lines).encode() + (end.encode() if n > 1 else b""))
        want |= {(name, k): line for k, line in enumerate(lines)}
    (tmp_path / "bad.log").write_bytes(b"x\n\xff\xfey\n")
    want |= {("bad.log", 0): "x", ("bad.log", 1): "\ufffd\ufffdy"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = readers.read_lines(spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == len(want) and {(r.source_path.rsplit("/", 1)[1], r.line_no): r.line for r in rows} == want


TOOL = """---
tool_name: parse-meter
display_name: Parse Meter
description: >
  Parses the text
  of a reading
category: parsing
risk:
  level: L0
  side_effects: none
  idempotent: true
ownership:
  team: t
  service: ops-tools
input_schema:
  type: object
  required: [text]
  properties:
    text: {type: string, description: what to read}
errors:
  - code: INVALID_INPUT
    message: no text
    retryable: false
usage:
  when_to_use:
    - often
  called_by_skills: [a, b]
implementation: {type: mcp, endpoint: e}
---
"""


def test_tool_documents(spark, tmp_path):
    for name, text in (("one", TOOL), ("two", "tool_name: x\nrisk: none\n"), ("three", "a: [1"), ("four", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "TOOL.md").write_text(text)
    docs = readers.read_tool_documents(spark, str(tmp_path))
    got = {r.path.split("/")[-2]: r for r in docs.collect()}
    one = got["one"]
    assert (one.description, one.risk.level, one.risk.idempotent, one.risk.requires_approval) == ("Parses the text of a reading\n", "L0", True, None)
    assert one.input_schema.properties["text"].type == "string" and one.errors[0].retryable is False and one.usage.called_by_skills == ["a", "b"]
    assert got["two"].tool_name == "x" and got["two"].risk is None and got["three"].tool_name is None and "four" not in got
    registry = spark.createDataFrame([("other", None, None, "ops-tools", None)], "tool_name string, description string, display_name string, service string, input_fields array<string>")
    gate = {r.tool_name: r for r in admission.tool_gate(admission.tool_candidates(docs), registry).collect()}
    assert gate["parse-meter"].decision == "PASS" and gate["x"].reasons == ["service_missing", "risk_unknown", "no_callers", "category_unknown"]


def test_csv_front_matter_json(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿h1,h2\n1,\"a\nb\"\n".encode())
    (tmp_path / "SKILL.md").write_text("---\nname: x\n---\nbody")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    r = readers.read_csv_files(spark, str(tmp_path)).first()
    assert r.encoding == "utf-8-sig" and r.rows == [["h1", "h2"], ["1", "a\nb"]]
    assert readers.read_front_matter(spark, str(tmp_path)).first().fields == {"name": "x"}
    assert sorted(x.a for x in readers.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect() if x.a) == [1, 2]


def test_append_and_dry_run(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "k string")
    assert sinks.append_json(df, str(tmp_path / "m"), dry_run=True) == 1 and not (tmp_path / "m").exists()
    sinks.append_json(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    sinks.append_run(spark, str(tmp_path / "runs"), run_id="r", step_id="s", status="ok", detail={"n": 1})
    assert spark.read.json(str(tmp_path / "runs")).first().status == "ok"
    assert sinks.markdown_table(df, ["k"]).endswith("| a |")
    assert json.loads(sinks.badge(71))["color"] == "green"


def test_seams(spark):
    df = spark.createDataFrame([("a b c d",), (None,)], "t string")
    assert {r.failed for r in seams.call_model(df, "t", "reply").collect()} == {False}

    def broken(texts):
        raise RuntimeError

    assert {(r.reply, r.failed) for r in seams.call_model(df, "t", "reply", broken, attempts=1).collect()} == {(None, True)}
    v = seams.embed(df, "t", dimension=8).collect()
    assert all(len(r.embedding) == 8 and abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in v)


def _run(query):
    query.processAllAvailable()
    query.stop()


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(1, 0), (1, 540), (1, 1081), (2, 5), (1, 90_000)]
    df = spark.createDataFrame(rows, "user int, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    for n in (1, 3):
        src = tmp_path / f"in{n}"
        df.repartition(n).write.parquet(str(src))
        s = spark.readStream.schema(df.schema).parquet(str(src))
        _run(streams.fault_sessions(s, "user", "ts", 120, 300, 120).writeStream.format("memory").queryName(f"win{n}").outputMode("append").start())
        got = {(r.user, r.n_anchors) for r in spark.table(f"win{n}").collect()}
        assert {(1, 2), (1, 1), (2, 1)} >= got and (1, 2) in got
    batch = {(r.user, int(r.win_start.timestamp()), r.n_anchors) for r in streams.fault_sessions(df, "user", "ts", 120, 300, 120).collect()}
    assert batch == {(1, -120, 2), (1, 961, 1), (2, -115, 1), (1, 89_880, 1)}


def test_keep_latest_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), ("b", None, "z")], "k string, e double, v string")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _run(streams.keep_latest_stream(s, "k", "e", "v").writeStream.format("memory").queryName("latest").outputMode("update").start())
    assert {(r.k, r.value) for r in spark.table("latest").collect()} == {("a", "y"), ("b", "z")}


def test_upserts_and_passages(spark, tmp_path):
    write = streams.upsert_writer(str(tmp_path / "t"), "k")
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    write(spark.createDataFrame([("b", 2)], "k string, v int"), 1)
    write(spark.createDataFrame([("b", 2)], "k string, v int"), 1)  # a replay
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()} == {("a", 1), ("b", 2)}
    add = streams.new_passage_writer(str(tmp_path / "p"), "document string")
    for _ in range(2):
        add(spark.createDataFrame([("x",), ("x",), ("y",)], "document string"), 0)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_manifest_stream(spark, tmp_path):
    schema = "asset_id string, version string, created_at string, manifest_op string, manifest_emitted_at timestamp"
    write = streams.manifest_writer(str(tmp_path / "m"), schema)
    batch = spark.createDataFrame([("a", "1", "t0"), ("b", "1", "t0")], "asset_id string, version string, created_at string")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.schema(schema).json(str(tmp_path / "m")).count() == 2
