"""Incremental runs as streams: new files are extracted once, each micro-batch is appended, and a restart resumes.

Library-wide priors need all books, so only extraction and genre matching stream; ``plans.scan`` reads what they append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folianth.functions import columns as C
from folianth.operators.voting import gather
from folianth.sources import files

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)


def extract_new(spark: SparkSession, root: str, table: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Append the records (candidates and evidence) of files not seen before to a Parquet table, then stop.

    Books in archives are among them; files that are skipped (path, format) go to ``table``_skipped.
    """
    def batch(df: DataFrame, n: int) -> None:
        books, skipped = files.find_books(df)
        # A batch that runs again after a failure overwrites its own folder: each file is there once.
        gather(files.extract(books)).write.mode("overwrite").parquet(f"{table}/batch={n}")
        skipped.write.mode("overwrite").parquet(f"{table}_skipped/batch={n}")

    return new_files(spark, root, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def name_counts(mentions: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """key, window, n of a stream of (ts, name): how often each name is seen; late rows within the watermark count."""
    keyed = mentions.withWatermark("ts", late).select("ts", C.key("name").alias("key"))
    return keyed.groupBy(F.window("ts", every), "key").agg(F.count("*").alias("n"))
