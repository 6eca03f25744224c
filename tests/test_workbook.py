"""The workbook data source."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.sources import workbook as WB

NS = WB.MAIN[1:-1]


def book(path, sheets, strings=()):
    """A workbook with the given sheets (name -> XML of rows) and shared strings."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{WB.REL[1:].split("}")[0]}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" * (i % 2)}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{NS}">{rows}</worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")


@pytest.fixture
def source(spark):
    WB.register(spark)
    return lambda path, **o: spark.read.format("workbook").options(**o).load(str(path))


def test_cells_of_all_kinds(spark, source, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="inlineStr"><is><t>N</t></is></c></row>'
    rows = '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>4.5</v></c></row><row r="4"/><row r="5"><c r="C5" t="str"><f>A1</f><v>x</v></c><c r="AA5"><v>1</v></c></row>'
    book(tmp_path / "a.xlsx", {"one": f'<dimension ref="A1:AA5"/><sheetData>{head}{rows}</sheetData>', "two": "<sheetData><row><c t='inlineStr'><is><t>n</t></is></c></row><row><c><v>7</v></c></row></sheetData>"}, ["<t>unused</t>", "<t>name</t>", "<r><t>Mül</t></r><r><t>ler</t></r>"])
    df = source(tmp_path)
    assert df.columns == ["name", "c1", "n", "N_2", "_path", "_sheet", "_row"]
    got = sorted((tuple(r)[:4] + (r._sheet, r._row) for r in df.collect()), key=lambda r: r[4:])
    assert got == [("Müller", "true", "4.5", None, "one", 3), (None, None, None, None, "one", 4), (None, None, "x", None, "one", 5), (None, None, "7", None, "two", 2)]
    assert source(tmp_path, sheets="two").columns == ["n", "_path", "_sheet", "_row"]
    assert source(tmp_path, header="false", sheets="two").select("c0").collect() == [("n",), ("7",)]


def test_write_and_read_again_in_ranges(spark, source, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("share"), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" <&> "), F.col("id").cast("string"))).alias("text"), (F.col("id") % 2 == 0).alias("even"))
    out = str(tmp_path / "out")
    df.repartition(3).write.format("workbook").option("rowsperfile", 150).mode("append").save(out)
    files = os.listdir(out)
    assert len(files) >= 7 and all(f.endswith(".xlsx") and not f.startswith("_") for f in files)
    back = source(out, inferschema="true", rowsperpartition="40")
    assert [f.dataType.simpleString() for f in back.schema][:4] == ["bigint", "double", "string", "string"]
    assert sorted((r.id, r.share, r.text, r.even) for r in back.collect()) == [(r.id, r.share, r.text, "true" if r.even else "false") for r in df.orderBy("id").collect()]
    df.limit(1).write.format("workbook").mode("overwrite").save(out)
    assert source(out).count() == 1


def test_ranges_are_partitions(source, tmp_path):
    rows = "".join(f"<row r='{i}'><c r='A{i}'><v>{i}</v></c></row>" for i in range(1, 102))
    book(tmp_path / "a.xlsx", {"s": f'<dimension ref="A1:A101"/><sheetData>{rows}</sheetData>'})
    df = source(tmp_path, rowsperpartition="30")
    assert df.rdd.getNumPartitions() == 4 and sorted(int(r[0]) for r in df.collect()) == list(range(2, 102))


def test_bad_and_missing_files(spark, source, tmp_path):
    assert source(tmp_path).columns == ["_path", "_sheet", "_row"] and source(tmp_path).isEmpty()
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "~lock.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="zip"):
        source(tmp_path).count()
    book(tmp_path / "good.xlsx", {"s": "<sheetData><row><c t='inlineStr'><is><t>a</t></is></c></row><row><c><v>1</v></c></row></sheetData>"})
    assert source(tmp_path, mode="permissive").select("a").collect() == [("1",)]
    with pytest.raises(ValueError, match="all executors"):
        WB.local("s3://bucket/x")


def test_stream_reads_arriving_files_once(spark, tmp_path):
    WB.register(spark)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def put(name, n):
        book(src / name, {"s": f"<sheetData><row><c t='inlineStr'><is><t>a</t></is></c></row><row><c><v>{n}</v></c></row></sheetData>"})

    def run():
        df = spark.readStream.format("workbook").schema("a string, _sheet string").load(str(src))
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.a for r in spark.read.schema("a string, _sheet string").parquet(out).collect())

    put("b.xlsx", 1)
    assert run() == ["1"]
    put("a.xlsx", 2)
    assert run() == ["1", "2"]
    assert run() == ["1", "2"]
