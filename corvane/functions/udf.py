"""The few functions that SQL has no expression for, as Arrow-batched UDFs and table functions."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.ArrayType(T.ArrayType(T.StringType()))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip())


@F.pandas_udf(T.StringType())
def canonical_json_sha1(s: pd.Series) -> pd.Series:
    """sha1 of JSON with sorted keys and no spaces, other scripts kept."""

    def one(x):
        if x is None:
            return None
        body = json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return hashlib.sha1(body.encode()).hexdigest()

    return s.map(one)


@F.pandas_udf(T.StringType())
def asset_digest(meta: pd.Series, source: pd.Series) -> pd.Series:
    """sha256 of sorted JSON and, where there is one, the source's bytes."""

    def one(m, b):
        h = hashlib.sha256(json.dumps(json.loads(m), sort_keys=True, ensure_ascii=False).encode())
        if b is not None:
            h.update(bytes(b))
        return h.hexdigest()

    return pd.Series([one(m, b) for m, b in zip(meta, source, strict=True)])


def front_matter_of(text: str | None) -> tuple[dict[str, str], str]:
    """Keys of the block between the first two --- fences (continuation lines joined by a space), and the body."""
    m = re.match(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)(.*)\Z", text or "", re.S)
    if not m:
        return {}, text or ""
    out: dict[str, list[str]] = {}
    key = None
    for line in m[1].splitlines():
        head = re.match(r"([^\s:][^:]*):(.*)\Z", line)
        if head:
            key = head[1].strip()
            out[key] = [head[2].strip()]
        elif key is not None and line.strip():
            out[key].append(line.strip())
    return {k: " ".join(p for p in v if p) for k, v in out.items()}, m[2].strip()


@F.udf(T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType())]), useArrow=True)
def front_matter(text):
    fields, body = front_matter_of(text)
    return {"fields": fields, "body": body}


def tool_fields(text: str | None) -> dict:
    """Keys of a tool document: YAML, in --- fences or not. Where there is no YAML library, or the text is none that
    it reads, top keys with a text or a block list only."""
    body = text or ""
    if body.startswith("---"):
        body = body.split("---", 2)[1]
    try:
        import yaml

        found = yaml.safe_load(body)
        return found if isinstance(found, dict) else {}
    except ImportError:
        pass
    except yaml.YAMLError:
        pass
    out: dict = {}
    key = None
    for m in re.finditer(r"(?m)^(?:([\w-]+):[ \t]*(.*)|[ \t]+-[ \t]+(.*))$", body):
        if m[1]:
            key, value = m[1], m[2].strip().strip("\"'")
            out[key] = value or []
        elif key is not None and isinstance(out[key], list):
            out[key].append(m[3].strip().strip("\"'"))
    return out


@F.udf(T.StringType(), useArrow=True)
def tool_document(text):
    """The keys of a tool document as a JSON object."""
    return json.dumps(tool_fields(text), ensure_ascii=False, default=str)


def decoded(content: bytes) -> tuple[str, str]:
    """Text and the encoding that read it."""
    for encoding in ("utf-8-sig", "utf-8", "gb18030"):
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore"), "utf-8-ignore"


@F.udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("rows", ROWS)]), useArrow=True)
def csv_rows(content):
    text, encoding = decoded(bytes(content or b""))
    return {"encoding": encoding, "rows": [list(r) for r in csv.reader(io.StringIO(text, newline=""))]}


@F.udf(ROWS, useArrow=True)
def html_table_rows(source):
    """Rows of cell texts, padded to one width."""
    if source is None:
        return None
    rows = []
    for row in re.findall(r"<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|\Z)", source, re.S | re.I):
        cells = re.findall(r"<t[hd]\b[^>]*>(.*?)(?=</t[hd]>|<t[hd]\b|\Z)", row, re.S | re.I)
        if cells:
            rows.append([re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", c)).strip() for c in cells])
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


@F.udf(ROWS, useArrow=True)
def gfm_table_rows(source):
    """Rows of a pipe table without its rule row."""
    if source is None:
        return None
    out = []
    for line in source.splitlines():
        line = line.strip()
        if "|" not in line or re.fullmatch(r"\|?[\s:|-]*-[\s:|-]*\|?", line):
            continue
        out.append([c.strip() for c in line.strip("|").split("|")])
    return out


def pack_paragraphs(text: str, most: int = 5000, overlap: int = 200, lossy: bool = False) -> list[str]:
    """Blocks of whole paragraphs of at most `most` characters, each later one with the tail of the one before.

    A paragraph that is too long alone is cut. With lossy, a paragraph that overflows a block longer
    than the overlap is dropped, as an older tool did.
    """
    out: list[str] = []
    held = ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if held and len(held) + 2 + len(p) <= most:
            held = f"{held}\n\n{p}"
            continue
        if held:
            out.append(held)
            tail = held[-overlap:] if overlap and len(held) > overlap else ""
            if lossy and tail:
                held = tail
                continue
            held = ""
            if tail and len(tail) + 2 + len(p) <= most:
                p = f"{tail}\n\n{p}"
        while len(p) > most:
            out.append(p[:most])
            p = p[most - overlap if not lossy else most :]
        held = p
    if held:
        out.append(held)
    return out


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def paragraph_blocks(text):
    return [] if text is None else pack_paragraphs(text)


def adaptive_chunks(text: str) -> list[str]:
    """Chunks for question extraction: larger documents are cut at second-level headings, then at lines. For one text; operators.docs has
    the same for a table."""
    n = len(text)
    size = n if n < 15000 else n // 2 if n < 30000 else 20000 if n < 80000 else 15000

    def packed(parts: list[str]) -> list[str]:
        out, held = [], ""
        for p in parts:
            if held and len(held) + len(p) > size:
                out.append(held)
                held = ""
            held += p
        return [*out, held] if held else out

    for mark in (r"(?m)^(?=## )", r"(?m)^(?=# )"):
        parts = [p for p in re.split(mark, text) if p]
        if len(parts) > 1:
            break
    chunks = packed(parts)
    if len(chunks) < 2 or max(map(len, chunks)) > 1.5 * size:
        chunks = packed(text.splitlines(keepends=True))
    return chunks
