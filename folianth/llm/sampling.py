"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def labelled(docs: DataFrame, known: DataFrame, seed: str, rows: int, cost: Column, most: int) -> DataFrame:
    """(y, text) of documents (doc_id, text) whose label ``known`` (doc_id, y) tells: the first in the order of a hash of the
    id, ``rows`` at most, as long as their ``cost`` (of a row of documents) adds up to ``most`` at most. A document that
    costs more than a twentieth of ``most`` isn't taken, so that none keeps many others out.

    Rows that repeat id and text count once. Only the bounded sample is sorted, and only a single pair of hashes leaves it.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = known.select("doc_id", "y", order.alias("o")).orderBy("o", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text", cost.cast("long").alias("cost")).join(F.broadcast(chosen), "doc_id")
    texts = texts.where(F.col("cost") <= most / 20).groupBy("o", F.xxhash64("text").alias("th")).agg(F.first("y").alias("y"), F.first("text").alias("text"), F.first("cost").alias("cost"))
    held = staged(texts, "sample")
    ranked = held.select("o", "th", "cost").orderBy("o", "th").limit(rows)
    spent = F.sum("cost").over(Window.orderBy("o", "th").rowsBetween(Window.unboundedPreceding, 0))
    last = ranked.withColumn("spent", spent).where(F.col("spent") <= most).agg(F.max(F.struct("o", "th"))).first()[0]
    return held.where(F.struct("o", "th") <= F.struct(F.lit(last["o"]), F.lit(last["th"]))).select("y", "text") if last else held.limit(0).select("y", "text")
