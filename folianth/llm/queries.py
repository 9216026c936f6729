"""The thin contract queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_quality, html_text, langid, license_scan, line_dedup, ngram_join, packing, tiff, toxicity, winnow
from .staging import table


def remainder(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"))
    model = crf_quality.train(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    return crf_quality.score(docs, model, keep=("doc_id", "held_out"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.tiff_pages(tiff.text_media(table(spark, sf_dir, "documents")), keep=("doc_id", "n_bytes"))
    return pages.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_license_scans": op2_license_scans,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_media_columns": op8_media_columns,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {
    "op2_license_scans": license_scan.SQL,
    "op4_benchmark_decontamination": winnow.SQL,
    "op5_line_dedup": line_dedup.SQL,
}
