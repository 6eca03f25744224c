"""Asset records of a whole knowledge folder: every kind of file by one pass over the listing, each record linked to its parent.

files: path (relative), version (digest of the content), size_bytes, and `body`: the text of a JSON file, of the sidecar for tables and
structured logs, else null. Bodies that aren't JSON count as empty. All kinds are columns of one projection, so a listing is
read once however many kinds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: The folders of the kinds below the data folder, and the suffixes that names lose.
ROOT = "processed_data"
MARKDOWN, TABLES, STRUCTURED, WINDOWS = (f"{ROOT}/{x}" for x in ("markdown", "table_cache", "log_cache/structured", "log_cache/fault_windows"))
QA, SEMANTIC, IMAGES = (f"{ROOT}/{x}" for x in ("qa_pair", "semantic_chunk", "images"))
SOURCES = "source_file"


def _field(*names: str) -> Column:
    """The first of the body's fields that isn't empty; null where none is."""
    return F.coalesce(*(F.nullif(F.try_variant_get("body", f"$.{n}", "string"), F.lit("")) for n in names))


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _stem() -> Column:
    return F.regexp_replace(_name(), r"(?<=.)\.[^.]*$", "")


def _in(folder: str, pattern: str) -> Column:
    """Files right in a folder whose names match."""
    return F.col("path").startswith(f"{folder}/") & ~F.contains(F.substr("path", F.lit(len(folder) + 2), F.lit(1 << 20)), F.lit("/")) & _name().rlike(pattern)


def kind_of() -> Column:
    """The kind of the file at `path`, null for others."""
    return (
        F.when(F.col("path").startswith(f"{SOURCES}/"), "source_file")
        .when(_in(MARKDOWN, r"_processed\.json$"), "document_processed")
        .when(_in(TABLES, r"\.csv$"), "table_csv")
        .when(_in(STRUCTURED, r"\.jsonl$"), "log_structured")
        .when(_in(WINDOWS, r"_fault_windows\.json$"), "log_fault_window_index")
        .when(_in(WINDOWS, r"_window_.*\.jsonl$"), "log_fault_window_segment")
        .when(_in(QA, r"\.json$") & ~_name().endswith(".metadata.json"), "qa_dataset")
        .when(_in(SEMANTIC, r"_for_chunking\.json$"), "semantic_dataset")
        .when(F.col("path").rlike(rf"^{IMAGES}/[^/]+/[^/]+$"), "image_asset")
    )


def _by_kind(values: dict[str, Column], default: Column | None = None) -> Column:
    chain = None
    for kind, value in values.items():
        chain = F.when(F.col("asset_type") == kind, value) if chain is None else chain.when(F.col("asset_type") == kind, value)
    return chain if default is None else chain.otherwise(default)


def _of(folder: str, name: Column, end: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), name, F.lit(end))


def _map(*names: str, **fields: Column) -> Column:
    pairs = [(n.split(".")[-1], _field(n)) for n in names] + list(fields.items())
    return F.create_map(*(x for n, c in pairs for x in (F.lit(n), c)))


def asset_records(files: DataFrame, as_of: Column) -> DataFrame:
    """One record for each file of a known kind. What a body says of layer, stage, names and times comes before what its kind implies;
    a missing updated_at is created_at or else as_of. A segment has its index as parent only if that is among the files."""
    x = files.select("path", "version", "size_bytes", F.try_parse_json("body").alias("body")).withColumn("asset_type", kind_of()).filter("asset_type is not null")
    source_type = F.coalesce(_field("metadata.source_type"), F.lit("document_qa"))
    qa_name = F.coalesce(_field("metadata.source"), F.regexp_replace(_stem(), "_qa", ""))
    doc_name = F.coalesce(_field("document_metadata.doc_name"), F.regexp_replace(_stem(), "_for_chunking", ""))
    processed = F.regexp_replace(_stem(), "_processed", "")
    doc_dir = F.element_at(F.split("path", "/"), -2)
    stem_of_windows = F.coalesce(_field("source_stem"), F.regexp_replace(_stem(), "_fault_windows", ""))
    parent_kind = _by_kind(
        {
            "document_processed": F.lit("source_file"),
            "log_fault_window_index": F.lit("log_structured"),
            "log_fault_window_segment": F.lit("log_fault_window_index"),
            "qa_dataset": F.when(source_type == "log_fault_segment", "log_fault_window_index").otherwise("document_processed"),
            "semantic_dataset": F.when(_field("document_metadata.source_type") == "table_csv", "table_csv").when(_field("document_metadata.source_type") == "log_fault_segment", "log_fault_window_index").otherwise("document_processed"),
            "image_asset": F.lit("document_processed"),
        }
    )
    own_windows = lambda name: _of(WINDOWS, name, "_fault_windows.json")
    own_document = lambda name: _of(MARKDOWN, name, "_processed.json")
    parent_path = _by_kind(
        {
            "document_processed": _field("metadata.source_path"),
            "log_fault_window_index": _field("source_jsonl"),
            "log_fault_window_segment": own_windows(F.regexp_extract(_stem(), r"^(.*)_window_", 1)),
            "qa_dataset": F.when(source_type == "log_fault_segment", own_windows(qa_name)).otherwise(own_document(qa_name)),
            "semantic_dataset": F.when(_field("document_metadata.source_type") == "table_csv", F.coalesce(_field("document_metadata.source_path"), F.lit(""))).when(_field("document_metadata.source_type") == "log_fault_segment", own_windows(doc_name)).otherwise(own_document(doc_name)),
            "image_asset": own_document(doc_dir),
        }
    )
    evidence, derived = F.lit("evidence"), F.lit("derived_index")
    layer = _by_kind(
        {
            "source_file": X.layer_of(F.substr("path", F.lit(len(SOURCES) + 2), F.lit(1 << 20))), "document_processed": F.coalesce(_field("asset_meta.knowledge_layer"), F.lit("normative")),
            "table_csv": F.coalesce(_field("knowledge_layer"), evidence), "log_structured": F.coalesce(_field("knowledge_layer"), evidence),
            "log_fault_window_index": F.coalesce(_field("asset_meta.knowledge_layer"), evidence), "log_fault_window_segment": evidence,
            "qa_dataset": F.coalesce(_field("asset_meta.knowledge_layer"), derived), "semantic_dataset": F.coalesce(_field("asset_meta.knowledge_layer"), derived),
        },
        derived,
    )
    display = _by_kind(
        {
            "source_file": _name(), "document_processed": F.coalesce(_field("metadata.source"), processed), "table_csv": F.coalesce(_field("display_name"), _name()),
            "log_structured": F.coalesce(_field("display_name"), _stem()), "log_fault_window_index": stem_of_windows, "log_fault_window_segment": _stem(), "qa_dataset": qa_name, "semantic_dataset": doc_name,
        },
        _name(),
    )
    source_name = _by_kind(
        {"source_file": _name(), "document_processed": F.coalesce(_field("metadata.source_raw"), processed), "table_csv": F.coalesce(_field("source_name"), _stem()), "log_structured": F.coalesce(_field("source_name"), _stem()), "image_asset": doc_dir},
        F.col("display_name"),
    )
    none = F.lit("")
    source_path = _by_kind(
        {
            "document_processed": F.coalesce(_field("metadata.source_path"), none), "table_csv": F.coalesce(_field("source_path"), F.col("path")), "log_structured": F.coalesce(_field("source_path"), F.col("path")),
            "log_fault_window_index": F.coalesce(_field("source_jsonl"), none), "qa_dataset": F.coalesce(_field("metadata.source_path"), none), "semantic_dataset": F.coalesce(_field("document_metadata.source_path"), none),
        },
        F.col("path"),
    )
    sidecar, inner, plain = ("table_csv", "log_structured"), ("log_fault_window_index", "qa_dataset", "semantic_dataset"), ("document_processed",)
    said = lambda n: F.when(F.col("asset_type").isin(*sidecar), _field(n)).when(F.col("asset_type").isin(*inner), _field(f"asset_meta.{n}"))
    written = F.when(F.col("asset_type").isin(*plain), _field("metadata.processed_at"))
    created = F.coalesce(said("created_at"), written, as_of)
    usual_stage = F.when(F.col("asset_type") == "source_file", "phase0").when(F.col("asset_type").isin("qa_dataset", "semantic_dataset"), "phase2").otherwise("phase1")
    truth = F.coalesce(said("is_source_of_truth").cast("boolean"), ~F.col("asset_type").isin("qa_dataset", "semantic_dataset", "image_asset"))
    size = F.col("size_bytes").cast("string")
    stats = _by_kind(
        {
            "document_processed": _map("metadata.section_count", "metadata.image_count", "metadata.reference_count", "metadata.total_chars"), "log_structured": _map("stats.record_count", size_bytes=size),
            "log_fault_window_index": _map("total_records", window_count=F.size(F.try_variant_get("body", "$.fault_windows", "array<variant>")).cast("string")),
            "qa_dataset": _map("metadata.segment_count", qa_count=_field("metadata.total")), "semantic_dataset": _map("document_metadata.chunk_count", "document_metadata.section_count", "document_metadata.image_count"),
        },
        _map(size_bytes=size),
    )
    suffix = F.lower(F.regexp_extract(_name(), r"(?<=.)(\.[^.]*)$", 1))
    attributes = _by_kind(
        {
            "source_file": _map(suffix=suffix), "table_csv": _map("attributes.sheet_name", "attributes.origin_excel_path", suffix=F.lit(".csv")), "image_asset": _map(doc_name=doc_dir, suffix=suffix),
            "document_processed": _map(*(f"metadata.{n}" for n in ("markdown_path", "images_dir", "table_placeholder_count", "table_summary_count", "table_file_count", "pdf_annotation_link_count"))),
            "log_fault_window_index": _map("case_id", "case_key", "device_sn", "window_seconds_before", "window_seconds_after", "merge_gap_seconds"),
            "qa_dataset": _map(source_type=source_type), "semantic_dataset": _map("document_metadata.source_type", "document_metadata.markdown_path"),
        },
        F.create_map().cast("map<string,string>"),
    )
    x = x.withColumn("display_name", display).withColumn("_parent", F.when(parent_path != "", parent_path)).withColumn("_kind", parent_kind)
    out = x.select(
        X.asset_id(F.col("asset_type"), F.col("path")).alias("asset_id"), "asset_type", layer.alias("knowledge_layer"), "display_name", source_name.alias("source_name"), source_path.alias("source_path"),
        F.col("path").alias("storage_path"), F.when(F.col("_parent").isNotNull(), X.asset_id(F.col("_kind"), F.col("_parent"))).alias("parent_asset_id"), "version", created.alias("created_at"),
        F.coalesce(said("updated_at"), written, created).alias("updated_at"), F.coalesce(said("pipeline_stage"), usual_stage).alias("pipeline_stage"), F.lit("ready").alias("status"),
        truth.alias("is_source_of_truth"), F.lit("system_generated").alias("review_status"),
        F.transform_values(stats, lambda _, v: F.coalesce(v.try_cast("bigint"), F.lit(0))).alias("stats"), F.map_filter(attributes, lambda _, v: v.isNotNull()).alias("attributes"), "_parent",
    )
    indexes = x.filter("asset_type = 'log_fault_window_index'").select(F.col("path").alias("_parent"), F.lit(True).alias("_known")).distinct()
    lost = (F.col("asset_type") == "log_fault_window_segment") & F.col("_known").isNull()
    return out.join(indexes, "_parent", "left").withColumn("parent_asset_id", F.when(~lost, F.col("parent_asset_id"))).drop("_parent", "_known")


def linked(records: DataFrame) -> DataFrame:
    """records with `parent_type` and `parent_found`: whether the parent is a record too."""
    parents = records.select(F.col("asset_id").alias("parent_asset_id"), F.col("asset_type").alias("parent_type")).distinct()
    return records.join(parents, "parent_asset_id", "left").withColumn("parent_found", F.col("parent_type").isNotNull())
