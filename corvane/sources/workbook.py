"""Workbooks (.xlsx) as a Spark data source: `spark.read.format("workbook")`, `readStream` for arriving files, and `df.write`.

A partition is a range of rows of one sheet, so that no task holds a workbook: a sheet's XML is read as a stream, and
of the shared strings only those that the range uses are kept. Paths are folders or files that the driver and all executors see (a
mounted store); files elsewhere go through `readers.read_workbooks`, which lets Spark fetch them.

Options: `path` (a folder, a file or a glob pattern), `sheets` (comma-separated names, all by default), `header` (true), `rowsperpartition`
(200,000), `inferschema` (false: all cells are strings). Columns are the first sheet's header; other sheets are read by the names of their
own, missing columns are null and further ones are left out. `_path`, `_sheet` and `_row` say where a row comes from. A file that isn't a
workbook is an error, or skipped with `mode` permissive.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PLACE = (T.StructField("_path", T.StringType()), T.StructField("_sheet", T.StringType()), T.StructField("_row", T.IntegerType()))
BATCH = 5_000


def local(path: str) -> str:
    """The path without the scheme of local files; others can't be opened here."""
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"\w+://", path):
        raise ValueError(f"{path}: workbooks are opened as files that all executors see")
    return path


def files_of(path: str) -> list[str]:
    path = local(path)
    found = glob.glob(os.path.join(path, "**", "*.xlsx"), recursive=True) if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in found if not os.path.basename(f).startswith(("~", ".", "_")))


def sheets_of(path: str) -> list[tuple[str, str, int | None]]:
    """Name, part and number of rows (None: not stated) of a workbook's sheets, in their order."""
    with zipfile.ZipFile(path) as z:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[s.get(REL)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            with z.open(part) as f:
                stated = re.search(rb'<(?:\w+:)?dimension[^>]*ref="[^":]*:?[A-Z]*(\d+)"', f.read(4096))
            out.append((s.get("name"), part, int(stated[1]) if stated else None))
        return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _rows(z: zipfile.ZipFile, part: str, first: int, last: int | None) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
    """Number and cells (column -> type and text) of a sheet's rows from first to last; the XML before and after is let go at once."""
    with z.open(part) as f:
        number, at = 0, -1
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start" and e.tag == f"{MAIN}sheetData":
                data = e
            if event == "start" or e.tag != f"{MAIN}row":
                continue
            number = int(e.get("r") or number + 1)
            if last is not None and number > last:
                return
            if number >= first:
                cells, at = {}, -1
                for c in e.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    kind, v = c.get("t") or "n", c.find(f"{MAIN}v")
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else v.text if v is not None else None
                    if text is not None:
                        cells[at] = (kind, text)
                yield number, cells
            data.clear()


def _shared(z: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings with the wanted numbers."""
    out: dict[int, str] = {}
    if not wanted or "xl/sharedStrings.xml" not in z.namelist():
        return out
    with z.open("xl/sharedStrings.xml") as f:
        n, root = 0, None
        for event, e in ET.iterparse(f, ("start", "end")):
            if root is None:
                root = e
            if event == "end" and e.tag == f"{MAIN}si":
                if n in wanted:
                    out[n] = "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
                n += 1
                root.clear()
                if len(out) == len(wanted):
                    break
    return out


def read_rows(path: str, part: str, first: int, last: int | None, batch: int = BATCH) -> Iterator[list[tuple[int, dict[int, str]]]]:
    """Rows with their texts, some thousands at a time; booleans are true and false."""
    with zipfile.ZipFile(path) as z:
        held: list = []

        def texts():
            strings = _shared(z, {int(v) for _, cells in held for kind, v in cells.values() if kind == "s"})
            text = lambda kind, v: strings.get(int(v), "") if kind == "s" else {"1": "true", "0": "false"}.get(v, v) if kind == "b" else v
            return [(n, {i: text(*c) for i, c in cells.items()}) for n, cells in held]

        for row in _rows(z, part, first, last):
            held.append(row)
            if len(held) == batch:
                yield texts()
                held = []
        if held:
            yield texts()


@dataclass
class Range(InputPartition):
    path: str
    sheet: str
    part: str
    first: int
    last: int | None

    def __post_init__(self) -> None:
        super().__init__(f"{self.path}#{self.sheet}:{self.first}")


@dataclass(frozen=True)
class Wanted:
    """What the options ask for."""

    path: str
    sheets: tuple[str, ...]
    header: bool
    rows: int
    infer: bool
    permissive: bool

    @classmethod
    def of(cls, options: dict) -> Wanted:
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        names = tuple(x.strip() for x in options.get("sheets", "").split(",") if x.strip())
        return cls(options["path"], names, flag("header", True), int(options.get("rowsperpartition", 200_000)), flag("inferschema", False), options.get("mode", "").lower() == "permissive")

    def ranges(self, files: list[str]) -> list[Range]:
        out = []
        for path in files:
            try:
                sheets = sheets_of(path)
            except (zipfile.BadZipFile, KeyError, ET.ParseError):
                if not self.permissive:
                    raise
                continue
            for name, part, n in sheets:
                if self.sheets and name not in self.sheets:
                    continue
                begin = 2 if self.header else 1
                cuts = range(begin, n + 1, self.rows) if n else [begin]
                out += [Range(path, name, part, a, a + self.rows - 1 if n else None) for a in cuts]
        return out

    def names(self, path: str, part: str) -> list[str]:
        """Names of a sheet's columns: of its first row, c0, c1, ... where that has none; equal ones are numbered."""
        first = next(read_rows(path, part, 1, 1), [(1, {})])[0][1]
        names, seen = [], {}
        for i in range(max(first, default=-1) + 1):
            name = (first.get(i) or "").strip() if self.header else ""
            name = name or f"c{i}"
            seen[name.lower()] = seen.get(name.lower(), 0) + 1
            names.append(name if seen[name.lower()] == 1 else f"{name}_{seen[name.lower()]}")
        return names

    def schema(self) -> T.StructType:
        ranges = self.ranges(files_of(self.path))
        if not ranges:
            return T.StructType(list(PLACE))
        r = ranges[0]
        names = self.names(r.path, r.part)
        kinds: list[T.DataType] = [T.StringType() for _ in names]
        if self.infer:
            some = next(read_rows(r.path, r.part, r.first, r.first + 999), [])
            for i in range(len(names)):
                cells = [c[i] for _, c in some if c.get(i)]
                if cells and all(re.fullmatch(r"-?\d{1,18}", c) for c in cells):
                    kinds[i] = T.LongType()
                elif cells and all(re.fullmatch(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", c) for c in cells):
                    kinds[i] = T.DoubleType()
        return T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)] + list(PLACE))


def _read(wanted: Wanted, schema: T.StructType, r: Range | None) -> Iterator[pa.RecordBatch]:
    if r is None:  # there are no files
        return
    arrow = to_arrow_schema(schema)
    at = {n: i for i, n in reversed(list(enumerate(wanted.names(r.path, r.part))))}

    def cast(text: str | None, kind: pa.DataType):
        if text is None or pa.types.is_string(kind):
            return text
        try:
            return int(float(text)) if pa.types.is_integer(kind) else float(text) if pa.types.is_floating(kind) else None
        except (ValueError, OverflowError):
            return None

    for rows in read_rows(r.path, r.part, r.first, r.last):
        columns = []
        for f in arrow:
            if f.name in ("_path", "_sheet"):
                values = [r.path if f.name == "_path" else r.sheet] * len(rows)
            elif f.name == "_row":
                values = [n for n, _ in rows]
            else:
                values = [cast(c.get(at[f.name]), f.type) if f.name in at else None for _, c in rows]
            columns.append(pa.array(values, f.type))
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)


class Reader(DataSourceReader):
    def __init__(self, wanted: Wanted, schema: T.StructType):
        self.wanted, self.schema = wanted, schema

    def partitions(self) -> list[Range]:
        return self.wanted.ranges(files_of(self.wanted.path))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.wanted, self.schema, partition)


class StreamReader(DataSourceStreamReader):
    """Files that arrive: an offset is the newest file that was read, by time and path."""

    def __init__(self, wanted: Wanted, schema: T.StructType):
        self.wanted, self.schema = wanted, schema

    def _keys(self) -> list[tuple[int, str]]:
        return sorted((os.stat(f).st_mtime_ns, f) for f in files_of(self.wanted.path))

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        keys = self._keys()
        return {"time": keys[-1][0], "path": keys[-1][1]} if keys else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.wanted.ranges([f for t, f in self._keys() if low < (t, f) <= high])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.wanted, self.schema, partition)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class Writer(DataSourceWriter):
    """A workbook with one sheet for each partition's rows, at most `rowsperfile` in a file; files get their names when all are written."""

    def __init__(self, path: str, schema: T.StructType, rows: int, overwrite: bool):
        self.path, self.columns, self.rows, self.overwrite, self.run = local(path), schema.names, rows, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[T.Row]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done, rows = [], iter(iterator)
        while (row := next(rows, None)) is not None:
            done.append(os.path.join(self.path, f"_{self.run}-{uuid.uuid4().hex}.part"))
            with zipfile.ZipFile(done[-1], "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in FRAME.items():
                    z.writestr(name, text)
                with z.open("xl/worksheets/sheet1.xml", "w") as f:
                    f.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                    f.write(_row(1, self.columns))
                    n = 1
                    while row is not None:
                        n += 1
                        f.write(_row(n, row))
                        row = next(rows, None) if n <= self.rows else None
                    f.write(b"</sheetData></worksheet>")
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        new = [p for m in messages if m is not None for p in m.paths]
        if self.overwrite:
            for f in files_of(self.path):
                os.remove(f)
        for p in new:
            os.replace(p, p.replace(os.sep + "_", os.sep)[: -len(".part")] + ".xlsx")

    def abort(self, messages: list[Written | None]) -> None:
        for p in glob.glob(os.path.join(self.path, f"_{self.run}-*.part")):
            os.remove(p)


#: The parts of a workbook with one sheet.
FRAME = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _row(n: int, values) -> bytes:
    cells = []
    for v in values:
        if v is None:
            cells.append("<c/>")
        elif isinstance(v, bool):
            cells.append(f'<c t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, int | float) and v == v and abs(v) < 1e15:
            cells.append(f"<c><v>{v!r}</v></c>")
        else:
            cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'.encode()


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return Wanted.of(self.options).schema()

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(Wanted.of(self.options), schema)

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(Wanted.of(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, int(self.options.get("rowsperfile", 1_000_000)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Workbooks)

