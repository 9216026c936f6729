"""A training corpus from raw documents: each stage reads what the one before wrote.

A document's label is learned from only where crc32(doc_id as text) mod 3 is not 1, as in the
quality query. Packing ends the run, so SQL cannot express it: ORACLE_SQL is None, and a test holds
the rows against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folianth.llm import crf_quality, line_dedup, ngram_join, packing, winnow
from folianth.llm.queries import remainder
from folianth.llm.staging import staged, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = crf_quality.train(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    scored = crf_quality.score(docs, model, keep=tuple(docs.columns), names=("__score", "__predicted"))
    return scored.where(F.col("__predicted") == 1).drop("__score", "__predicted")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; a document of which only white space is left goes."""
    return line_dedup.deduplicated(docs, drop_emptied=True)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
