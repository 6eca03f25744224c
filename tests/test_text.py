import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.plans import records
from corvane.functions import udf as U
from corvane.session import resolve_config, set_by_path


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: X.message_template(L("took 12 ms for \"a b\" and 'c'\n x")), "took <*> ms for <*> and <*> x"),
        (lambda: X.case_id(L("x evshwt-12__y")), "EVSHWT-12"),
        (lambda: X.serial_number(L("AB1234ABCDEFGHIJ")), "AB1234ABCDEFGHIJ"),
        (lambda: X.serial_number(L("none")), ""),
        (lambda: X.case_key(L("EVSHWT-12__x")), "EVSHWT-12"),
        (lambda: X.safe_stem(L(" .a:b?. ")), "a_b"),
        (lambda: X.safe_stem(L("._")), "unknown"),
        (lambda: X.safe_sheet(L("Müller & Co")), "Müller___Co"),
        (lambda: X.safe_sheet(L("###")), "sheet"),
        (lambda: X.doc_refs(L('a [[DOC_REF name="x y"]] b [[DOC_REF name="z"]] [[DOC_REF name="x y"]]')), ["x y", "z"]),
        (lambda: F.size(X.table_refs(L('[[TABLE type="file" summary="s" path="p"]] [[TABLE type="summary" summary="t"]]'))), 2),
        (lambda: X.image_refs(L("![a](b.png) ![](c.jpg)")), ["b.png", "c.jpg"]),
        (lambda: X.replace_embedded(L("a ![x](data:image/png;base64,QUJD) b ![y](data:image/png;base64,QUJD)"), F.array(L("1.png"))), "a ![](1.png) b "),
        (lambda: X.table_file(L("doc_table_2.csv"))[1], 2),
        (lambda: X.table_file(L("plain.csv"))[0], "plain"),
        (lambda: X.truncated(L("ab\ncdefg"), 5), "ab c…"),
        (lambda: X.layer_of(L("evidence/a.pdf")), "evidence"),
        (lambda: X.layer_of(L("a.PDF")), "normative"),
        (lambda: X.normal_path(L("a\\b//./c ")), "a/b/c"),
        (lambda: X.relative_path(L("/base/a/b"), "/base"), "a/b"),
        (lambda: X.endpoint_of(L(""), L("srv"), L("do-it")), "srv:do_it()"),
        (lambda: F.size(X.qa_items(L('text [{"question":"q ","answer":"a"},{"question":"","answer":"b"}] more'))), 1),
        (lambda: X.qa_items(L('```json\n[{"question":"q","answer":"a"}]\n```'))[0]["category"], "general"),
        (lambda: F.size(X.qa_items(L("no json"))), 0),
        (lambda: X.ratio_text(L(12), L(8)), "3:2"),
        (lambda: X.gcd(L(0), L(0)), 0),
        (lambda: X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 0.0),
        (lambda: X.cosine(F.array(L(0.0)), F.array(L(1.0))), None),
        (lambda: X.asset_id(L("source_file"), L("a/b")), "source_file:" + "".join(__import__("hashlib").sha1(b"source_file|a/b").hexdigest())[:24]),
        (lambda: X.mask_name(L("张三")), "张*"),
        (lambda: X.mask_middle(L("110101199001011234"), 3, 4), "110***********1234"),
        (lambda: X.mask_middle(L("13812345678"), 3, 4, 4), "138****5678"),
        (lambda: X.mask_amount(L(1234567.89)), "~¥123万"),
        (lambda: X.mask_email(L("zhangsan@bank.com")), "z***@bank.com"),
        (lambda: X.mask_address(L("北京市朝阳区建国路88号")), "北京市朝阳区***"),
        (lambda: X.mask_company(L("某某科技有限公司")), "某某***公司"),
        (lambda: X.mask_credit(L("评分720，含3条逾期记录")), "评分720，含逾期记录（N条）"),
        (lambda: X.media_type(F.unhex(L("FFD8FF00")), L("a.png")), "image/jpeg"),
        (lambda: X.media_type(F.unhex(L("00")), L("a.webp")), "image/webp"),
        (lambda: F.length(X.safe_file_name(F.repeat(L("a"), 300))), 120),
    ],
)
def test_expression(spark, make, want):
    assert one(spark, make()) == want


def test_nfkc_and_canonical_json(spark):
    assert one(spark, U.nfkc(L("ｆｕｌｌ　width"))) == "full width"
    a, b = one(spark, U.canonical_json_sha1(L('{"b":1,"a":"é"}'))), one(spark, U.canonical_json_sha1(L('{"a": "é", "b": 1}')))
    assert a == b


def test_front_matter():
    fields, body = U.front_matter_of("---\nname: x\npurpose: one\n  two\n---\nbody\n")
    assert fields == {"name": "x", "purpose": "one two"} and body == "body"
    assert U.front_matter_of("no fence") == ({}, "no fence")


def test_csv_encodings():
    assert U.decoded("﻿a,b".encode())[0] == "a,b"
    assert U.decoded("中文".encode("gb18030")) == ("中文", "gb18030")
    assert U.decoded(b"\xff\xff\xff")[1] == "utf-8-ignore"


def test_tables(spark):
    assert one(spark, U.html_table_rows(L("<table><tr><th>a<th>b</tr><tr><td>1</td></tr></table>"))) == [["a", "b"], ["1", ""]]
    assert one(spark, U.gfm_table_rows(L("| a | b |\n|---|---|\n| 1 | 2 |"))) == [["a", "b"], ["1", "2"]]


def test_paragraph_packing_loses_no_text():
    text = "\n\n".join(f"p{i} " + "x" * (i * 37 % 900) for i in range(60)) + "\n\n" + "y" * 12_000
    blocks = U.pack_paragraphs(text, 5000, 200)
    assert all(len(b) <= 5000 for b in blocks)
    joined = "\n".join(blocks)
    assert all(f"p{i}" in joined for i in range(60)) and joined.count("y") >= 12_000
    lossy = U.pack_paragraphs("\n\n".join("z" * 900 for _ in range(20)), 5000, 200, lossy=True)
    assert sum(b.count("z") for b in lossy) < 18_000


def test_adaptive_chunks_keep_every_character():
    for text in ("# a\nshort", "## h\n" + "line\n" * 5000, "x" * 40_000, "## a\n" + "b" * 30_000 + "\n## c\n" + "d" * 60_000):
        assert "".join(U.adaptive_chunks(text)) == text


def test_config():
    got = resolve_config({"root": "/r", "a": {"x_dir": "${root}/in", "y": "${env:NOPE}"}}, "/base", {})
    assert got["a"] == {"x_dir": "/r/in", "y": ""}
    assert set_by_path({"a": {"b": 1}}, "a.c", "1") == {"a": {"b": 1, "c": True}}
    assert set_by_path({}, "n", "12") == {"n": 12}


def test_images_are_replaced_in_one_cut(spark):
    """However many images a text has, and the parts of a small file are worked on by several tasks."""
    n = 300
    text = "".join(f"{i}![p](data:image/png;base64,QUJD)" for i in range(n)) + "end"
    out = spark.range(1).select(X.replace_embedded(F.lit(text), F.array(F.lit("a"), F.lit("b"))).alias("x")).first().x
    assert out == "0![](a)1![](b)" + "".join(map(str, range(2, n))) + "end"
    parts = records.prj16_embedded_images(spark, "/root/testdata/sf0.001")
    assert parts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
