"""Knowledge data from raw folders: tables found in documents, processed documents, question-answer sets of log segments, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from .docs import lines_of, sections
from .manifest import latest

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "webp")


def table_cells(line: Column) -> Column:
    """Cells of a row of a pipe table, trimmed: what stands between the first and the last bar; an escaped bar is text."""
    bare = F.regexp_replace(F.trim(line), r"\\\|", "\u0001")
    parts = F.split(bare, r"\|")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.trim(F.regexp_replace(c, "\u0001", "|")))


def padded(rows: Column) -> Column:
    """Rows with empty cells up to the widest."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def _is_rule(line: Column) -> Column:
    return F.trim(line).rlike(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$") & F.contains(line, F.lit("|"))


def _spans(lines: Column) -> Column:
    """Where tables are in lines: an array of (start_line, end_line), in order.

    A letter stands for each line (fence, rule, other bar, any other), and a text of them is cut to code blocks, tables, other runs of bars,
    and the rest."""
    bare = lambda x: F.trim(x)
    kind = lambda x: F.when(bare(x).startswith("```"), "f").when(~bare(x).startswith("|"), ".").when(_is_rule(x), "r").otherwise("b")
    runs = F.regexp_extract_all(F.array_join(F.transform(lines, kind), ""), F.lit(r"f[^f]*f?|[br]r[br]*|[br]+|\.+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_line:int,end_line:int>>").alias("found"))

    def step(acc, run):
        end = acc["at"] + F.length(run)
        span = F.struct(acc["at"].alias("start_line"), end.alias("end_line"))
        return F.struct(end.alias("at"), F.when(run.rlike("^[br]r"), F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(runs, start, step)["found"]


def document_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, start_line, end_line, rows, markdown of the pipe tables in documents, numbered from 1 in order of their lines.

    A table is a run of lines that begin with a bar, with a rule (dashes) as the second, outside code fences; the rule is no row, and rows are
    padded to the widest. end_line is the line after the last. A document's tables are found in its row: nothing is shuffled. Rows of one key are
    documents of their own."""
    own = lambda lines, s: F.slice(lines, s["start_line"] + 1, s["end_line"] - s["start_line"])
    # the lines are bound by a transform of one element, so that they are cut once
    found = F.transform(F.array(F.split(text, "\n")), lambda lines: F.transform(_spans(lines), lambda s: F.struct(s["start_line"], s["end_line"], own(lines, s).alias("l"))))
    x = docs.filter(F.contains(text, F.lit("|"))).select(key, F.posexplode(F.get(found, F.lit(0))).alias("_n", "_t"))
    x = x.select(key, (F.col("_n") + 1).alias("table_no"), "_t.start_line", "_t.end_line", "_t.l")
    rows = F.transform(F.filter("l", lambda line, i: ~((i > 0) & _is_rule(line))), table_cells)
    return x.select(key, "table_no", "start_line", "end_line", rows.alias("rows"), F.array_join("l", "\n").alias("markdown")).withColumn("rows", padded(F.col("rows")))


def html_rows(html: Column) -> Column:
    """Rows of an HTML table as arrays of cell texts: tags go, entities of four kinds are read, white space is one space; rows are padded."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), "&nbsp;", " "), "&lt;", "<"), "&gt;", ">"), "&quot;", '"'), "&amp;", "&"), r"\s+", " "))
    trs = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|</table\s*>|\z)"), F.lit(1))
    rows = F.transform(trs, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</t[hd]\s*>|<t[hd]\b|\z)"), F.lit(1)), plain))
    return padded(rows)


def refilled(rows: Column, texts: Column) -> Column:
    """rows with the texts in place of their non-empty cells, in order, where there are as many; else rows as they are."""
    flat = F.flatten(rows)
    full = F.filter(flat, lambda c: c != "")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, c: F.struct((acc["n"] + (c != "").cast("int")).alias("n"), F.array_append(acc["out"], F.when(c != "", F.try_element_at(texts, acc["n"] + 1)).otherwise(c)).alias("out"))
    new = F.aggregate(flat, start, step)["out"]
    width = F.size(F.get(rows, F.lit(0)))
    cut = F.transform(rows, lambda r, i: F.slice(new, i * width + 1, F.size(r)))
    return F.when((F.size(full) == F.size(texts)) & (F.size(full) > 0), cut).otherwise(rows)


def replace_tables(docs: DataFrame, key: str, text: str, name: str = "doc_name") -> DataFrame:
    """docs with each table of `text` as a placeholder that names its file, in a line of its own."""
    found = document_tables(docs.select(key, text), key, text)
    lines = lines_of(docs, key, text).join(found.select(key, "table_no", "start_line", "end_line").withColumn("line_no", F.explode(F.sequence("start_line", F.col("end_line") - 1))), [key, "line_no"], "left")
    lines = lines.join(docs.select(key, F.col(name).alias("_name")), key)
    mark = F.format_string('[[TABLE type="file" summary="%s_table_%d.csv" path="%s_table_%d.csv"]]', "_name", "table_no", "_name", "table_no")
    shown = F.when(F.col("table_no").isNull(), F.col("line")).when(F.col("line_no") == F.col("start_line"), mark)
    g = lines.select(key, "line_no", shown.alias("s")).filter("s is not null").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda p: p["s"]), "\n").alias("_text"))  # one document's lines
    return docs.join(g, key, "left").withColumn(text, F.coalesce("_text", text)).drop("_text")


def processed_documents(docs: DataFrame, as_of: Column) -> DataFrame:
    """doc_name, metadata, references, full_text, sections, images, tables of documents (doc_name, path, content): embedded images become
    files, tables placeholders, then sections and references are read. Documents are one row a name; a null content is empty."""
    x = docs.select("doc_name", "path", F.coalesce("content", F.lit("")).alias("content"))
    names = F.transform(X.embedded_images(F.col("content")), lambda _, i: F.concat(F.col("doc_name"), F.lit("_image_"), (i + 1).cast("string"), F.lit(".png")))
    x = x.withColumn("images", names).withColumn("content", X.replace_embedded(F.col("content"), F.col("images")))
    tables = document_tables(x, "doc_name", "content").groupBy("doc_name").agg(F.array_sort(F.collect_list(F.struct("table_no", "rows"))).alias("tables"))  # of one document
    x = replace_tables(x.withColumn("_name", F.col("doc_name")), "doc_name", "content", "_name").drop("_name")
    secs = sections(x, "doc_name", "content").groupBy("doc_name").agg(F.array_sort(F.collect_list(F.struct("section_index", "title", "content", "level"))).alias("sections"))  # of one document
    x = x.join(secs, "doc_name", "left").join(tables, "doc_name", "left").withColumn("references", X.doc_refs(F.col("content")))
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    about = F.struct(F.col("doc_name").alias("source"), F.col("path").alias("source_path"), as_of.alias("processed_at"), count("images").alias("image_count"), count("sections").alias("section_count"), count("references").alias("reference_count"), count("tables").alias("table_file_count"), F.length("content").cast("bigint").alias("total_chars"))
    return x.select("doc_name", about.alias("metadata"), "references", F.col("content").alias("full_text"), "sections", "images", "tables")


def known_documents(processed: DataFrame) -> DataFrame:
    """doc_name: the distinct names of processed documents (metadata.source), blank ones left out."""
    return processed.select(F.trim("metadata.source").alias("doc_name")).filter("doc_name <> ''").distinct()


def log_sets(segments: DataFrame, answers: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(QA sets, chunk sets) by source stem, from segments (source_stem, window_id, segment, text, knowledge_layer, start_ts, end_ts), answers (segment,
    pos, question, answer) and summaries (segment, summary).

    Segments of blank text take no part but count; a set's layer is that of its first segment, evidence where that has none. Pairs without question or answer and blank
    summaries are left out, and stems without any get no set."""
    first = F.min_by(F.coalesce("knowledge_layer", F.lit("evidence")), F.struct("window_id", "segment"))
    about = segments.groupBy("source_stem").agg(F.count("*").alias("segment_count"), first.alias("knowledge_layer"))
    live = segments.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    qa = live.join(answers.filter(filled("question") & filled("answer")), "segment")
    pair = F.struct("window_id", "pos", "segment", F.trim("question").alias("question"), F.trim("answer").alias("answer"))
    qa_sets = qa.groupBy("source_stem").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(pair)).alias("qa_pairs")).join(about, "source_stem")  # of one log file
    chunk_id = F.format_string("%s_log_window_%s", "source_stem", F.col("window_id").cast("string"))
    chunk = F.struct("window_id", chunk_id.alias("chunk_id"), "segment", "start_ts", "end_ts", F.col("summary").alias("content"))
    chunks = live.join(summaries.filter(filled("summary")), "segment")
    chunk_sets = chunks.groupBy("source_stem").agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_list(chunk)).alias("chunks")).join(about.drop("segment_count"), "source_stem")  # of one log file
    return qa_sets, chunk_sets


def passages(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """hash_id, document, kind, meta of question-answer pairs (question, answer, meta) and chunks (title, doc_name, content, meta), one row a text: of equal
    texts the chunk's, then that with the largest meta, stays. Blank texts are left out."""
    q = qa.select(F.concat_ws("\n", F.trim("question"), F.trim("answer")).alias("document"), F.lit("qa").alias("kind"), F.to_json("meta").alias("meta"))
    c = chunks.select(F.concat_ws("\n", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("doc_name")), F.trim("content")).alias("document"), F.lit("semantic").alias("kind"), F.to_json("meta").alias("meta"))
    every = q.unionByName(c).filter(F.col("document").rlike(r"\S")).withColumn("hash_id", X.passage_id(F.col("document")))
    return latest(every, ["hash_id"], [F.desc("kind"), F.desc("meta")]).select("hash_id", "document", "kind", "meta")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """doc_name, relative_path, media_type, base64 of the images in `<path>/<doc>/<file>`."""
    suffixes = "{" + ",".join(v for s in IMAGE_SUFFIXES for v in (s, s.upper())) + "}"
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    x = df.withColumn("doc_name", F.element_at(parts, -2)).withColumn("name", F.element_at(parts, -1))
    depth = path.rstrip("/").split("/")[-1]
    x = x.filter(F.element_at(parts, -3) == depth)
    return x.select("doc_name", F.concat_ws("/", "doc_name", "name").alias("relative_path"), X.media_type(F.col("content"), F.col("name")).alias("media_type"), F.base64("content").alias("base64"))


def read_ci_reports(spark: SparkSession, path: str, schema: str = "asset_name string, asset_type string, decision string, score double") -> DataFrame:
    """The reports of `ci_*.json` files by asset_name: files that aren't JSON or name no asset are left out, of several for one asset the file that
    comes last by name counts."""
    fields = f"{schema}, _corrupt string"
    df = spark.read.schema(fields).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "ci_*.json").json(path)
    x = df.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    x = x.filter(F.col("_corrupt").isNull() & (F.coalesce("asset_name", F.lit("")) != ""))
    return latest(x, ["asset_name"], [F.desc("_file")]).drop("_corrupt", "_file")


def named(files: DataFrame, exact: str | None = None, part: str | None = None) -> DataFrame:
    """files whose `name` is `exact`, or contains `part`; None doesn't restrict."""
    if exact is not None:
        files = files.filter(F.col("name") == exact)
    return files if part is None else files.filter(F.contains("name", F.lit(part)))


def by_severity(findings: DataFrame, column: str, *ties: str) -> DataFrame:
    """findings with the worst first: `column` as text, largest first, nulls last; then by the other columns."""
    return findings.orderBy(F.col(column).desc_nulls_last(), *ties)
