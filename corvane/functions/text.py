"""Column expressions for text: parsing, normalising, extracting, formatting. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats of log lines, placeholders and references.
LOG_LINE = r"(?s)^[0-9]#:[0-9]+:\[([^\]]*)\]:([^:]*):([^:]*):[0-9]+:tid:([0-9]+):(.*)$"
TIMESTAMP = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?$"
DOC_REF = r'\[\[DOC_REF\s+name="([^"]+)"\s*\]\]'
TABLE_REF = r'\[\[TABLE\s+type="(summary|file)"\s+summary="([^"]*)"(?:\s+path="([^"]*)")?\s*\]\]'
IMAGE_REF = r"!\[[^\]]*\]\(([^)]+)\)"
DATA_IMAGE = r"!\[[^\]]*\]\(data:image/[a-zA-Z+]+;base64,([A-Za-z0-9+/=\s]+)\)"
CASE_ID = r"(?i)EVSHWT-\d+"
SERIAL = r"[A-Z]{2}\d{4}[A-Z0-9]{10,}"


def log_fields(line: Column) -> dict[str, Column]:
    """Timestamp text, module, level, thread and message of a log line; null where it isn't one."""
    hit = line.rlike(LOG_LINE)
    part = lambda k: F.when(hit, F.trim(F.regexp_extract(line, LOG_LINE, k)))
    return {"ts": part(1), "module": part(2), "level": F.lower(part(3)), "tid": part(4), "message": part(5)}


def epoch_of(ts: Column) -> Column:
    """Seconds since 1970 (UTC). The fraction is read as whole milliseconds: `.3` is 3 ms, beyond 999 the time is null."""
    part = lambda k: F.regexp_extract(ts, TIMESTAMP, k)
    millis = F.coalesce(F.nullif(part(7), F.lit("")), F.lit("0"))
    fits = ts.rlike(TIMESTAMP) & (F.length(F.ltrim(millis, F.lit("0"))) <= 3)
    whole = F.try_to_timestamp(F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), F.concat_ws(":", part(4), part(5), part(6))), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(fits, F.unix_timestamp(whole).cast("double") + millis.try_cast("int") / 1000)


def epoch_text(epoch: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS.mmm`, milliseconds cut off, not rounded."""
    return F.date_format(F.timestamp_micros(F.floor(epoch * 1000) * 1000), "yyyy-MM-dd HH:mm:ss.SSS")


def message_template(message: Column, most: int = 500) -> Column:
    """Numbers and quoted parts become <*>, white space single spaces."""
    out = message
    for pattern in (r"\d+", r'"[^"]*"', r"'[^']*'"):
        out = F.regexp_replace(out, pattern, "<*>")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def case_id(s: Column) -> Column:
    return F.upper(F.regexp_extract(s, CASE_ID, 0))


def serial_number(s: Column) -> Column:
    return F.regexp_extract(s, SERIAL, 0)


def case_key(stem: Column) -> Column:
    return F.trim(F.substring_index(stem, "__", 1))


def safe_stem(stem: Column) -> Column:
    cleaned = F.trim(F.regexp_replace(stem, r'[<>:"/\\|?*;]', "_"), F.lit("._ "))
    return F.coalesce(F.nullif(F.substring(cleaned, 1, 120), F.lit("")), F.lit("unknown"))


def safe_sheet(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), F.lit("_")), F.lit("")), F.lit("sheet"))


def safe_file_name(name: Column, most: int = 120) -> Column:
    """A name any file system takes; long ones end in a digest of the whole."""
    s = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "_+", "_"), F.lit(" ._"))
    s = F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed"))
    short = F.concat(F.rtrim(F.substring(s, 1, most - 10), F.lit(" ._")), F.lit("__"), F.substring(F.sha1(s), 1, 8))
    return F.when(F.length(s) > most, short).otherwise(s)


def normal_ref(ref: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ref, '"', "'"), r"\s+", " "))


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or `.` parts."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    return F.array_join(F.transform(parts, lambda p: F.trim(p)), "/")


def relative_path(path: Column, base: str) -> Column:
    posix = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    lead = base.rstrip("/") + "/"
    return F.when(posix.startswith(lead), F.substring(posix, len(lead) + 1, 1 << 20)).otherwise(posix)


def doc_refs(content: Column) -> Column:
    """Distinct non-empty reference names in order."""
    names = F.transform(F.regexp_extract_all(content, F.lit(DOC_REF), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def table_refs(content: Column) -> Column:
    """Array of (type, summary, path) of table placeholders."""
    group = lambda k: F.regexp_extract_all(content, F.lit(TABLE_REF), F.lit(k))
    return F.arrays_zip(group(1).alias("type"), group(2).alias("summary"), group(3).alias("path"))


def image_refs(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(IMAGE_REF), F.lit(1))


def embedded_images(content: Column, least: int = 1000) -> Column:
    """Decoded images of at least `least` bytes."""
    raw = F.transform(F.regexp_extract_all(content, F.lit(DATA_IMAGE), F.lit(1)), lambda s: F.unbase64(F.regexp_replace(s, r"\s", "")))
    return F.filter(raw, lambda b: F.octet_length(b) >= least)


def replace_embedded(content: Column, names: Column) -> Column:
    """The i-th embedded image becomes a reference to the i-th name; without a name it goes."""
    follows = lambda i: F.coalesce(F.concat(F.lit("![]("), F.get(names, i), F.lit(")")), F.lit(""))
    filled = lambda between: F.transform(between, lambda s, i: F.concat(s, F.when(i < F.size(between) - 1, follows(i)).otherwise("")))
    # the pieces are bound by a transform of one element: a text is cut once, not once a piece
    return F.array_join(F.get(F.transform(F.array(F.split(content, DATA_IMAGE, -1)), filled), F.lit(0)), "")


def table_file(name: Column) -> tuple[Column, Column]:
    """Document and table number of `doc_table_2.csv`; otherwise the stem and null."""
    pattern = r"^(.*)_table_(\d+)\.csv$"
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    hit = name.rlike(pattern)
    return F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(stem), F.when(hit, F.regexp_extract(name, pattern, 2).try_cast("int"))


def truncated(s: Column, most: int = 160) -> Column:
    one = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), "\n", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def table_summary(name: Column, headers: Column, rows: Column, n_rows: Column, n_columns: Column) -> Column:
    """A sentence on a table's shape, its first eight headers and 3 x 4 sample cells."""
    heads = F.array_join(F.slice(F.filter(headers, lambda h: h != ""), 1, 8), "、")
    sample = F.transform(F.slice(rows, 1, 3), lambda r: F.array_join(F.filter(F.transform(F.slice(r, 1, 4), lambda c: truncated(c)), lambda c: c != ""), " / "))
    sample = F.array_join(F.filter(sample, lambda x: x != ""), "；")
    filled = lambda c, other: F.when(c == "", other).otherwise(c)
    return F.format_string("表格 %s 包含 %d 行、%d 列的结构化数据，主要字段包括：%s。示例值：%s。", name, n_rows, n_columns, filled(heads, "无明确表头"), filled(sample, "无示例值"))


def table_chunk(name: Column, doc: Column, summary: Column, headers: Column, rows: Column, n_rows: Column, n_columns: Column) -> Column:
    """The searchable text of a table: shape, summary, headers and five sample rows."""
    cells = lambda xs: F.array_join(F.transform(xs, lambda c: truncated(c, 80)), " | ")
    head = F.when(F.size(headers) > 0, cells(F.filter(headers, lambda h: h != ""))).otherwise("(无表头)")
    lines = F.transform(F.slice(rows, 1, 5), lambda r, i: F.concat(F.lit("- 第"), (i + 1).cast("string"), F.lit("行: "), cells(F.slice(r, 1, 8))))
    lines = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("- (无数据行)")
    return F.trim(F.format_string("# 表格摘要：%s\n\n文档来源：%s\n行列规模：%d 行 × %d 列\n摘要：%s\n\n表头：\n%s\n\n示例数据：\n%s", name, doc, n_rows, n_columns, summary, head, lines))


#: Knowledge layers by suffix.
NORMATIVE = ("pdf", "md")
EVIDENCE = ("log", "txt", "jsonl", "csv", "xls", "xlsx", "xlsm", "xltx", "xltm")
LAYERS = ("normative", "evidence", "memory_case", "memory_rule", "derived_index")


def layer_of(rel_path: Column) -> Column:
    """The first folder if it names a layer, else by suffix."""
    parts = F.split(rel_path, "/")
    suffix = F.lower(F.regexp_extract(rel_path, r"\.([^./]+)$", 1))
    by_suffix = F.when(suffix.isin(*NORMATIVE), "normative").when(suffix.isin(*EVIDENCE), "evidence").otherwise("derived_index")
    return F.when((F.size(parts) >= 2) & F.get(parts, 0).isin(*LAYERS), F.get(parts, 0)).otherwise(by_suffix)


def log_line_text(ts: Column, module: Column, level: Column, message: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws(" ", F.concat(F.lit("["), text(ts), F.lit("]")), text(module), F.concat(text(level), F.lit(":")), F.trim(text(message)))


def endpoint_of(endpoint: Column, service: Column, tool: Column) -> Column:
    return F.coalesce(F.nullif(endpoint, F.lit("")), F.concat(service, F.lit(":"), F.translate(tool, "-", "_"), F.lit("()")))


def json_array_text(reply: Column) -> Column:
    """The JSON array in a model's reply: in a fence, else from the first bracket to the last, else all of it."""
    fence = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.trim(F.coalesce(F.nullif(F.trim(fence), F.lit("")), F.nullif(bare, F.lit("")), reply))


QA_SCHEMA = "array<struct<question:string,answer:string,category:string,keywords:array<string>>>"


def qa_items(reply: Column, default_category: str = "general") -> Column:
    """Question-answer items of a reply: trimmed, those without question or answer dropped; what isn't a list is no items."""
    items = F.coalesce(F.from_json(json_array_text(reply), QA_SCHEMA), F.array().cast(QA_SCHEMA))
    tidy = F.transform(
        F.filter(items, lambda q: (F.trim(F.coalesce(q["question"], F.lit(""))) != "") & (F.trim(F.coalesce(q["answer"], F.lit(""))) != "")),
        lambda q: F.struct(
            F.trim(q["question"]).alias("question"),
            F.trim(q["answer"]).alias("answer"),
            F.coalesce(F.nullif(F.trim(q["category"]), F.lit("")), F.lit(default_category)).alias("category"),
            F.coalesce(q["keywords"], F.array().cast("array<string>")).alias("keywords"),
        ),
    )
    return tidy


def qa_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("问题: "), question, F.lit("\n\n答案: "), answer)


def flat_metadata(values: dict[str, tuple[Column, int]]) -> Column:
    """A string map of (column, most characters)."""
    entries = [x for k, (c, most) in values.items() for x in (F.lit(k), F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, most))]
    return F.create_map(*entries)


def media_type(content: Column, name: Column) -> Column:
    """By first bytes, then by suffix, else PNG."""
    head = F.hex(F.substring(content, 1, 12))
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(suffix.isin("jpg", "jpeg"), "image/jpeg")
        .when(suffix.isin("gif", "webp"), F.concat(F.lit("image/"), suffix))
        .otherwise("image/png")
    )


# -- similarity -------------------------------------------------------------------------------


def word_tokens(s: Column) -> Column:
    """Distinct words of three characters or more, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; two empty ones have 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def hits(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """The words that occur in a text as substrings, case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 48 of them do for 32-bit numbers."""
    start = F.struct(F.greatest(a, b).cast("bigint").alias("x"), F.least(a, b).cast("bigint").alias("y"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % F.greatest(s["y"], F.lit(1))).alias("y")))
    return end["x"]


def ratio_text(a: Column, b: Column) -> Column:
    g = F.greatest(gcd(a, b), F.lit(1))
    return F.concat_ws(":", (a / g).cast("bigint").cast("string"), (b / g).cast("bigint").cast("string"))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


# -- identity ---------------------------------------------------------------------------------


def asset_id(kind: Column, path: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", kind, path)), 1, 24))


def qa_id(source: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit("qa_"), F.substring(F.sha1(F.concat_ws("||", source, question, answer)), 1, 24))


def passage_id(text: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.md5(text))


# -- masking ----------------------------------------------------------------------------------


def mask_name(s: Column) -> Column:
    return F.concat(F.substring(s, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(s) - 1, F.lit(0))))


def mask_middle(s: Column, head: int, tail: int, stars: int | None = None) -> Column:
    """First `head` and last `tail` characters; stars for what lies between, or a fixed number of them."""
    n = F.greatest(F.length(s) - head - tail, F.lit(0)) if stars is None else F.lit(stars)
    return F.when(F.length(s) <= head + tail, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.substring(s, 1, head), F.repeat(F.lit("*"), n), F.right(s, F.lit(tail))))


def mask_amount(amount: Column) -> Column:
    return F.concat(F.lit("~¥"), F.floor(amount / 10000).cast("string"), F.lit("万"))


def mask_email(s: Column) -> Column:
    return F.concat(F.substring(s, 1, 1), F.lit("***@"), F.substring_index(s, "@", -1))


def mask_address(s: Column) -> Column:
    """Kept to the district."""
    return F.concat(F.coalesce(F.nullif(F.regexp_extract(s, r"^(.*?[区县])", 1), F.lit("")), F.substring(s, 1, 6)), F.lit("***"))


def mask_company(s: Column) -> Column:
    return F.concat(F.substring(s, 1, 2), F.lit("***"), F.coalesce(F.nullif(F.regexp_extract(s, r"(公司|集团|银行)$", 1), F.lit("")), F.lit("公司")))


def mask_credit(s: Column) -> Column:
    """Details become counts."""
    return F.regexp_replace(s, r"含?\d+条([^，。]*)", "含$1（N条）")
