"""Documents: sections, chunks, references, question-answer assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions import udf as U

NUMBERED = r"^#+\s*\d+\."


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_index, title, level, content. Lines that begin with # open a section; if any heading is numbered
    only numbered ones do, and the part before them is an `Introduction` even if empty. Otherwise a section needs a
    body, but the last one is kept without."""
    x = lines_of(docs, key, text)
    whole = W.partitionBy(key)
    w = whole.orderBy("line_no")
    x = x.withColumn("cases", F.max(F.col("line").rlike(NUMBERED).cast("int")).over(whole) == 1)
    x = x.withColumn("head", F.when(F.col("cases"), F.col("line").rlike(NUMBERED)).otherwise(F.col("line").startswith("#")))
    x = x.withColumn("sid", F.sum(F.col("head").cast("int")).over(w))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda p: p["line"])
    g = x.groupBy(key, "sid", "cases").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("heading"), F.trim(F.array_join(body, "\n"), F.lit(" \n\t")).alias("content"))
    marks = F.regexp_extract("heading", r"^(#+)", 1)
    g = g.withColumn("level", F.coalesce(F.length(marks), F.lit(1))).withColumn("title", F.coalesce(F.trim(F.regexp_replace("heading", r"^#+", "")), F.lit("Introduction")))
    last = F.max("sid").over(W.partitionBy(key)) == F.col("sid")
    g = g.withColumn("last", last).filter((F.col("content") != "") | F.col("last") | F.col("cases"))
    return g.select(key, (F.row_number().over(W.partitionBy(key).orderBy("sid")) - 1).alias("section_index"), "title", "level", "content")


def section_chunks(secs: DataFrame, key: str, most: int = 6000) -> DataFrame:
    """Chunks of sections: short ones whole under their heading, long ones in blocks, later ones marked as continued."""
    x = secs.filter(~((F.trim("title") == "") & (F.trim("content") == "")))
    heading = F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), F.col("title"))
    parts = F.when(F.length("content") <= most, F.array("content")).otherwise(U.paragraph_blocks("content"))
    x = x.withColumn("heading", heading).select(key, "section_index", "title", "level", "heading", F.posexplode(parts).alias("sub_index", "body"))
    x = x.withColumn("content", F.concat("heading", F.when(F.col("sub_index") > 0, F.format_string(" (续 %d)", F.col("sub_index"))).otherwise(""), F.lit("\n\n"), "body"))
    nth = F.row_number().over(W.partitionBy(key).orderBy("section_index", "sub_index")) - 1
    return x.select(key, F.concat_ws("__chunk_", F.col(key).cast("string"), nth.cast("string")).alias("chunk_id"), "title", "section_index", "sub_index", "level", F.length("content").alias("char_count"), X.doc_refs(F.col("content")).alias("refs_in_chunk"), "content")


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _packed(parts: Column, size: Column) -> Column:
    """Spans (begin, n) of runs of parts, each as long as size allows; a part that is longer stays whole."""
    start = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("n"), F.array().cast("array<struct<begin:int,n:int>>").alias("out"))
    held = lambda acc: F.array_append(acc["out"], F.struct(acc["begin"], acc["n"]))

    def step(acc, n):
        full = (acc["n"] > 0) & (acc["n"] + n > size)
        begin, length, out = (F.when(full, x).otherwise(y) for x, y in ((acc["begin"] + acc["n"], acc["begin"]), (n, acc["n"] + n), (held(acc), acc["out"])))
        return F.struct(begin.alias("begin"), length.alias("n"), out.alias("out"))

    return F.aggregate(F.transform(parts, F.length), start, step, lambda acc: F.when(acc["n"] > 0, held(acc)).otherwise(acc["out"]))


#: Ends of lines, as Python's splitlines has them.
LINE_END = r"(?<=\n|\r(?!\n)|[\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"


def _chunks(d: Column) -> Column:
    """Chunks of d.text, of about d.size characters: as functions.udf.adaptive_chunks, where its spans are."""
    parts = lambda pattern: F.filter(F.split(d["text"], pattern), lambda p: p != "")
    headed = _bound(parts(r"(?<=\n)(?=## )"), lambda p: F.when(F.size(p) > 1, p).otherwise(parts(r"(?<=\n)(?=# )")))
    uneven = lambda c: (F.size(c) < 2) | (2 * F.array_max(F.transform(c, lambda x: x["n"])) > 3 * d["size"])
    spans = _bound(_packed(headed, d["size"]), lambda c: F.when(uneven(c), _packed(parts(LINE_END), d["size"])).otherwise(c))
    return F.transform(spans, lambda s: F.substr(d["text"], s["begin"] + 1, s["n"]))


def adaptive_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_no, chunk: larger documents are cut at second-level headings, then at first-level ones, then at lines; shorter ones than
    15,000 characters are one chunk. A row's text is cut where it is, so no batch of texts is held."""
    x = docs.filter(F.col(text) != "").select(key, F.col(text).alias("_text"), F.length(text).alias("_n"))
    n = F.col("_n")
    size = F.when(n < 30000, F.floor(n / 2)).when(n < 80000, 20000).otherwise(15000).cast("int")
    cut = _bound(F.struct(F.col("_text").alias("text"), size.alias("size")), _chunks)
    return x.select(key, F.posexplode(F.when(n < 15000, F.array("_text")).otherwise(cut)).alias("chunk_no", "chunk"))


def reference_edges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (src, dst) of the references in each document."""
    return docs.select(F.col(key).alias("src"), F.explode(X.doc_refs(F.col(text))).alias("dst")).distinct()


def consolidated(edges: DataFrame) -> DataFrame:
    """src and its sorted distinct targets."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def read_edges(texts: DataFrame) -> DataFrame:
    """Distinct edges of `value`: an object of lists, a list of one-key objects, or lines of one-key objects."""
    lists = F.from_json("value", "map<string,array<string>>")
    pairs = F.from_json("value", "array<map<string,string>>")
    as_lists = texts.select(F.explode(F.map_entries(lists)).alias("e")).select(F.col("e.key").alias("src"), F.explode("e.value").alias("dst"))
    as_pairs = texts.filter(F.ltrim("value").startswith("[")).select(F.explode(pairs).alias("m")).select(F.explode("m").alias("src", "dst"))
    lines = texts.select(F.explode(F.split("value", "\n")).alias("line")).filter(F.trim("line").startswith("{"))
    as_lines = lines.select(F.explode(F.from_json("line", "map<string,string>")).alias("src", "dst")).filter(~F.col("dst").startswith("["))
    return as_lists.unionByName(as_pairs).unionByName(as_lines).filter("src is not null and dst is not null").distinct()


def match_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """ref -> doc_name by rank: equal, one contains the other, the same without white space; then longest, then first name.

    known is the list of documents of one collection. Of two texts one of which contains the other, the longer has the first
    three characters of the shorter somewhere (or all of it, if there are fewer), so candidates come from equi joins on pieces of
    one to three characters.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    head = lambda c: F.substr(c, F.lit(1), F.lit(3))
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*(F.substr(c, i, F.lit(n)) for n in (1, 2, 3))))))
    r = refs.select("ref").distinct().withColumn("_r", bare(F.col("ref"))).filter("_r <> ''")
    k = known.select("doc_name").distinct().withColumn("_k", bare(F.col("doc_name"))).filter("_k <> ''")
    inside = r.withColumn("_g", F.explode(pieces(F.col("_r")))).join(k.withColumn("_g", head(F.col("_k"))), "_g")
    around = r.withColumn("_g", head(F.col("_r"))).join(k.withColumn("_g", F.explode(pieces(F.col("_k")))), "_g")
    pairs = inside.unionByName(around).select("ref", "doc_name", "_r", "_k").distinct()
    a, b = F.lower("ref"), F.lower("doc_name")
    level = F.when(a == b, 1).when(F.contains(a, b) | F.contains(b, a), 2).when(F.contains(F.col("_r"), F.col("_k")) | F.contains(F.col("_k"), F.col("_r")), 3)
    w = W.partitionBy("ref").orderBy("level", F.length("doc_name").desc(), "doc_name")
    return pairs.withColumn("level", level).filter("level is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("ref", "doc_name", "level")


def insert_references(docs: DataFrame, links: DataFrame) -> DataFrame:
    """doc_name, content with a reference placeholder after the first place of each anchor text (unless one is within
    80 characters); anchors that aren't found go to a list at the end."""
    by_doc = links.groupBy("doc_name").agg(F.array_sort(F.collect_set("anchor_text")).alias("anchors"))

    def step(acc, anchor):
        words = F.filter(F.split(anchor, r"[\s\W_]+"), lambda p: p != "")
        pattern = F.concat(F.lit("(?i)"), F.array_join(F.transform(words, lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), r"[\s\W_]*"))
        mark = F.concat(F.lit('[[DOC_REF name="'), X.normal_ref(anchor), F.lit('"]]'))
        found = F.regexp_substr(acc["text"], pattern)
        at = F.instr(acc["text"], found)
        near = F.contains(F.substr(acc["text"], F.greatest(at - 80, F.lit(1)), F.length(found) + 160), F.lit("[[DOC_REF"))
        put = F.concat(F.substr(acc["text"], F.lit(1), at + F.length(found) - 1), F.lit(" "), mark, F.substr(acc["text"], at + F.length(found), F.length(acc["text"])))
        return F.struct(F.when(found.isNull() | near, acc["text"]).otherwise(put).alias("text"), F.when(found.isNull(), F.array_append(acc["rest"], mark)).otherwise(acc["rest"]).alias("rest"))

    x = docs.join(by_doc, "doc_name", "left")
    start = F.struct(F.col("content").alias("text"), F.array().cast("array<string>").alias("rest"))
    x = x.withColumn("acc", F.aggregate(F.coalesce("anchors", F.array().cast("array<string>")), start, step))
    tail = F.when(F.size("acc.rest") > 0, F.concat(F.lit("\n\n## References\n\n"), F.array_join("acc.rest", "\n"))).otherwise("")
    return x.select("doc_name", F.concat("acc.text", tail).alias("content"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """path, rows (array of arrays) -> one chunk per table with its shape, summary and text."""
    doc, nth = X.table_file(F.element_at(F.split("path", "/"), -1))
    name = F.element_at(F.split("path", "/"), -1)
    x = tables.select("path", name.alias("csv_name"), doc.alias("doc_name"), nth.alias("table_index"), F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>")).alias("headers"), F.slice("rows", 2, 1 << 30).alias("body"), "rows")
    x = x.withColumn("row_count", F.size("body")).withColumn("column_count", F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)))
    args = lambda: (F.col("headers"), F.col("body"), F.col("row_count"), F.col("column_count"))
    x = x.withColumn("summary", X.table_summary(F.col("csv_name"), *args()))
    return x.withColumn("content", X.table_chunk(F.col("csv_name"), F.col("doc_name"), F.col("summary"), *args())).drop("rows", "body")


def qa_pairs(turns: DataFrame) -> DataFrame:
    """A user turn and the assistant turn that follows it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    x = x.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).filter((F.trim("text") != "") & (F.trim("answer") != ""))
    q, a = F.trim("text"), F.trim("answer")
    return x.select("conv_id", "turn", q.alias("question"), a.alias("answer"), X.qa_id(F.col("conv_id").cast("string"), q, a).alias("qa_id"), X.qa_text(q, a).alias("document"))


def qa_markdown(pairs: DataFrame, key: str) -> DataFrame:
    """One text per source: `## Qn:` blocks in order."""
    block = F.concat(F.lit("## Q"), F.col("n").cast("string"), F.lit(": "), F.col("question"), F.lit("\n\n"), F.col("answer"))
    x = pairs.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("turn")))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda p: p["b"])
    return x.groupBy(key).agg(F.count("*").alias("n_pairs"), F.array_join(blocks, "\n\n").alias("markdown"))


def image_chunks(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Images that a chunk refers to, with the chunks' ids: by normal path, else by document and file name."""
    refs = chunks.select("doc_name", "chunk_id", F.explode(X.image_refs(F.col("content"))).alias("ref"))
    refs = refs.withColumn("path_key", X.normal_path(F.col("ref"))).withColumn("base", F.element_at(F.split("path_key", "/"), -1))
    im = images.withColumn("path_key", X.normal_path(F.col("path"))).withColumn("base", F.element_at(F.split("path_key", "/"), -1))
    by_path = im.join(refs.select("path_key", "chunk_id"), "path_key").select("path", "chunk_id", F.lit(1).alias("by"))
    by_name = im.join(refs.select("doc_name", "base", "chunk_id"), ["doc_name", "base"]).select("path", "chunk_id", F.lit(2).alias("by"))
    both = by_path.unionByName(by_name)
    best = both.withColumn("best", F.min("by").over(W.partitionBy("path"))).filter("by = best")
    return best.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("chunk_id")), ",").alias("chunk_ids"))


def listing(df: DataFrame, equal: dict, at: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows that meet those of the conditions that are given; None doesn't restrict."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if since is not None:
        df = df.filter(F.col(at) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        df = df.filter(F.col(at) <= F.lit(until).cast("timestamp_ntz"))
    return df


def with_tags(df: DataFrame, tags: str, required: list[str]) -> DataFrame:
    """Rows that have all required tags."""
    return df.filter(F.size(F.array_except(F.array(*(F.lit(t) for t in required)), F.col(tags))) == 0)
