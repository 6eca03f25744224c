"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, html, langid, linededup, negatives, ngram_join, oracles, packing, pii, quality, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=lambda doc_id: ~toxicity.is_held_out(doc_id))
    return toxicity.score_documents(docs, model, held_out=toxicity.is_held_out)


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_table(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, usable=lambda doc_id: ~langid.is_held_out(doc_id))
    return langid.identify_documents(docs, model, held_out=langid.is_held_out)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_in_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.session_key(spark), report=True)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_table(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_table(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_exact_top_k,
    op2_html_extraction,
    op3_toxicity,
    op4_warc_transactions,
    op5_byte_bpe,
    op6_quality_rules,
    op7_ngram_jaccard_join,
    op8_best_fit_packing,
    op9_language_id,
    op10_pii_surrogates,
    op11_line_dedup,
    op12_source_divergence,
    op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in _ALL}

#: DuckDB SQL for the queries that it can express.
ORACLES: dict[str, str] = oracles.ORACLES
