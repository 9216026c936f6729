"""Small inputs and append-only logs with their schemas: overrides, configuration, report, logs, cached answers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folianth.functions import columns as C
from folianth.functions import fixed
from folianth.sources import staging

REPORT = "path string, archive string, author string, coauthors string, title string, confidence double, sources string, candidates string, status string"
MOVES = "src string, original string, author string, format string, status string, dest string, error string, tag_error string, parked string, merge boolean, `from` string, unplaced string, seq bigint"
GENRES = "book string, genres array<string>, old_tags string, error string, harmonized boolean, seq bigint"
RENAMES = "renamed string, `to` string, title string, seq bigint"
CACHE = "file_key string, field string, value string, seq bigint"


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """rule_pos (file order: the first rule wins), from, to, kind (name or file)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("rule_pos", "line")).where("rule_pos > 0")
    row = F.from_csv("line", F.lit("`from` string, `to` string"))
    rules = lines.select("rule_pos", row.alias("r")).select("rule_pos", F.trim("r.from").alias("raw"), F.trim("r.to").alias("to"))
    rules = rules.where((F.coalesce("raw", F.lit("")) != "") & ~F.col("raw").startswith("#"))
    return classify_overrides(rules)


def classify_overrides(rules: DataFrame) -> DataFrame:
    """From (rule_pos, raw, to): file rules begin with "file:", hold a slash or end like a book or archive."""
    ends = F.lower("raw").rlike("(" + "|".join(x.replace(".", r"\.") for x in fixed.OVERRIDE_SUFFIXES) + ")$")
    marked = F.col("raw").startswith("file:")
    bare = F.when(marked, F.trim(F.substring("raw", 6, 1 << 20))).otherwise(F.col("raw"))
    for apart, whole in C._composed.items():
        bare = F.replace(bare, F.lit(apart), F.lit(whole))
    return rules.select("rule_pos", bare.alias("from"), "to", F.when(marked | F.contains("raw", F.lit("/")) | ends, "file").otherwise("name").alias("kind"))


def read_config(path: str | None = None, variable: str = "FOLIANTH_CONFIG") -> dict:
    """Settings from JSON; the environment names another file."""
    with open(os.environ.get(variable) or path, encoding="utf-8") as f:
        return json.load(f)


def flat_report(decided: DataFrame) -> DataFrame:
    """The reviewable form of the report: lists as text, rows in path order."""
    ranked = F.transform("candidates", lambda c: F.concat(c["name"], F.lit(" ("), c["score"].cast("string"), F.lit(")")))
    return decided.select(
        "path", "archive", "author", F.array_join("coauthors", "; ").alias("coauthors"), "title", "confidence",
        F.array_join("sources", "+").alias("sources"), F.array_join(ranked, " | ").alias("candidates"), "status",
    ).orderBy("path")


def write_report(decided: DataFrame, path: str) -> None:
    """One CSV, as people review it; the rows are few columns wide, one per book."""
    flat_report(decided).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a JSON-lines log; ``seq`` is the order in which they were appended."""
    return spark.read.schema(schema).json(path)


def read_log_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return read_log(spark, path, schema) if staging.exists(spark, path) else None


def append_log(entries: DataFrame, path: str, batch: int, order: list[str]) -> None:
    """Append entries with ``seq``: the batch number, then the place within the batch by ``order``.

    Entries are sorted over all partitions; a partition's places go on where the one before it ends, so only the sizes of
    partitions are added up in one task.
    """
    numbered = entries.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    numbered = staging.staged(numbered.withColumn("__p", F.shiftright("__id", 33)).withColumn("__k", F.col("__id").bitwiseAND((1 << 33) - 1)), "log-entries")
    sizes = numbered.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__before"))
    seq = F.lit(batch).cast("long") * (1 << 40) + F.col("__before") + F.col("__k") + 1
    numbered.join(F.broadcast(before), "__p").withColumn("seq", seq).drop("__p", "__k", "__id", "__before").write.mode("append").json(path)


def next_batch(log: DataFrame | None) -> int:
    """The batch number after all those of a log."""
    last = log.agg(F.max("seq")).first()[0] if log is not None else None
    return 0 if last is None else (last >> 40) + 1


def retire_log(spark: SparkSession, path: str) -> str:
    """Put an undone log aside, so that it counts no more."""
    base = path.rstrip("/").removesuffix(".log")
    n, to = 1, f"{base}.undone.log"
    while staging.exists(spark, to):
        n, to = n + 1, f"{base}.undone{n}.log"
    staging.rename(spark, path, to)
    return to


def placed_sources(log: DataFrame, existing: DataFrame) -> DataFrame:
    """path of what has been placed: entries with a source and a destination that still exists."""
    there = existing.select(F.col("path").alias("dest")).distinct()
    return log.where("src is not null and dest is not null").join(there, "dest", "left_semi").select(F.col("src").alias("path")).distinct()


def cached(files: DataFrame, cache: DataFrame, field: str) -> DataFrame:
    """Adds the cached value of ``field`` (null if none) to files with a ``file_key``: the one remembered last."""
    last = cache.where(F.col("field") == field).groupBy("file_key").agg(F.max_by("value", F.struct("seq", "value")).alias(field))
    return files.join(last, "file_key", "left")


def remember(values: DataFrame, path: str, seq: int = 0) -> None:
    """Append (file_key, field, value) rows; of several for one key and field those of the largest ``seq`` count."""
    values.select("file_key", "field", "value", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(path)
