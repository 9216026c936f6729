"""Command line over the verbs: ``python -m folianth.cli scan --library DIR --report DIR`` and the like.

Plans are written as tables. ``--execute`` also carries them out on a file system that every worker mounts, and appends to
the logs in the output folder, from which the next run resumes. ``--shared`` names the folder for tables in between, which
are deleted at the end; on a cluster it must be given here or as spark.checkpoint.dir.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    scan = sub.add_parser("scan", help="decide who wrote each book below a folder")
    scan.add_argument("--library", required=True)
    scan.add_argument("--only", help="a folder below the library")
    scan.add_argument("--report", required=True)
    scan.add_argument("--overrides")
    scan.add_argument("--limit", type=int)
    place = sub.add_parser("apply", help="plan the placement of confident books")
    place.add_argument("--report", required=True)
    place.add_argument("--library", help="the folder that was scanned; books of it that are wholly placed are parked")
    place.add_argument("--min-confidence", type=float, default=0.4)
    genres = sub.add_parser("genres", help="match genre answers to the taxonomy")
    genres.add_argument("--answers", required=True)
    genres.add_argument("--author")
    genres.add_argument("--retag", action="store_true")
    rename = sub.add_parser("rename", help="plan cleaner file names")
    harmonize = sub.add_parser("harmonize", help="plan genres that copies, series and authors share")
    undo = sub.add_parser("undo", help="plan the reversal of a log")
    for x in (place, genres, rename, harmonize, undo):
        x.add_argument("--output", required=True, help="the sorted library")
        x.add_argument("--plan", required=True, help="where the plan is written")
    for x in (place, genres, rename):
        x.add_argument("--limit", type=int)
    for x in (place, genres, rename, undo):
        x.add_argument("--execute", action="store_true", help="carry the plan out and log it")
    for x in (scan, place, genres, rename, harmonize, undo):
        x.add_argument("--shared", help="a folder that all machines share")
    for x in (genres, rename):
        x.add_argument("--dry-run", action="store_true", help="show the plan only")
    return p


def main(argv: list[str] | None = None) -> int:
    from folianth.sources import staging

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("folianth").getOrCreate()
    if args.shared:
        spark.conf.set("spark.checkpoint.dir", args.shared)
    for root in ("library", "output"):
        if getattr(args, root, None):
            setattr(args, root, staging.qualified(spark, getattr(args, root)))
    try:
        return _scan(spark, args) if args.verb == "scan" else _plan(spark, args)
    finally:
        staging.release(spark)


def _scan(spark: SparkSession, args: argparse.Namespace) -> int:
    from folianth.plans import scan as verbs
    from folianth.sources import files, tables

    root = f"{args.library}/{args.only}" if args.only else args.library
    books, skipped = files.find_books(files.read_files(spark, root), args.limit)
    rules = tables.read_overrides(spark, args.overrides) if args.overrides else None
    report = verbs.scan(files.extract(books), overrides=rules)
    tables.write_report(report, args.report)
    # The reviewable report has no formats, which were found by content.
    books.select("path", "format").write.mode("overwrite").parquet(f"{args.report.rstrip('/')}.formats")
    verbs.summary(tables.read_report(spark, args.report)).show()
    return 0


def _plan(spark: SparkSession, args: argparse.Namespace) -> int:
    from folianth.operators.voting import status_counts
    from folianth.plans import executors
    from folianth.plans import scan as verbs
    from folianth.sources import files, staging, tables

    listed = files.read_files(spark, args.output).select("path")
    logs = {"moves": tables.MOVES, "genres": tables.GENRES, "renames": tables.RENAMES}
    log = {name: tables.read_log_if_any(spark, f"{args.output}/{name}.log", schema) for name, schema in logs.items()}

    def append(name: str, entries, order: list[str]) -> None:
        tables.append_log(staging.staged(entries, "done"), f"{args.output}/{name}.log", tables.next_batch(log[name]), order)

    if args.verb == "apply":
        report = tables.read_report(spark, args.report).withColumn("coauthors", F.split("coauthors", "; "))
        formats = f"{args.report.rstrip('/')}.formats"
        if staging.exists(spark, formats):
            report = report.join(spark.read.parquet(formats), "path", "left")
        else:
            report = report.withColumn("format", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)))
        plan = staging.staged(verbs.apply(report, log["moves"], listed, args.output, args.min_confidence, args.limit), "plan")
        status_counts(plan).show()
    elif args.verb == "genres":
        books = files.read_files(spark, args.output)
        tagged = books.withColumn("__t", files.embedded_tags(files.detect(), "content")).select("path", F.col("__t.tags").alias("tags"))
        answers = spark.read.json(args.answers)
        plan = verbs.genres(files.listing(tagged.select("path"), args.output).join(tagged, "path"), log["genres"], answers, args.author, args.limit, args.retag)
    elif args.verb == "rename":
        plan = verbs.rename(files.listing(listed, args.output), args.limit)
    elif args.verb == "harmonize":
        plan = verbs.harmonize(tables.read_log(spark, f"{args.output}/genres.log", tables.GENRES), listed)
    else:
        plan = verbs.undo(tables.read_log(spark, f"{args.output}/moves.log", tables.MOVES))
    if getattr(args, "dry_run", False):
        plan.show(truncate=False)
        return 0
    plan.write.mode("overwrite").parquet(args.plan)
    plan = spark.read.parquet(args.plan)
    execute = getattr(args, "execute", False)
    if args.verb == "apply":
        placed = tables.placed_sources(log["moves"], listed) if log["moves"] is not None else plan.select("path").limit(0)
        done = plan.select("path", "dest", "status", "error")
        if execute:
            moved = staging.staged(executors.place(plan), "placed")
            done = moved.select("path", "dest", "status", "error")
            entries = plan.select("path", "original", "author", "format").join(moved.drop("original"), "path")
            append("moves", entries.withColumnRenamed("path", "src"), ["src"])
        if args.library:
            placed = placed.union(done.where(F.col("status").isin("done", "duplicate") & F.col("dest").isNotNull()).select("path")).distinct()
            park = verbs.parkable(report, placed, args.library, args.output)
            park.write.mode("overwrite").parquet(f"{args.plan.rstrip('/')}.park")
            if execute:
                log["moves"] = tables.read_log_if_any(spark, f"{args.output}/moves.log", tables.MOVES)
                parked = staging.staged(executors.move(spark.read.parquet(f"{args.plan.rstrip('/')}.park").select(F.col("original").alias("src"), F.col("parked").alias("to"))), "parked")
                append("moves", parked.where("error is null").select(F.col("src").alias("original"), F.col("to").alias("parked")), ["original"])
    elif args.verb == "genres" and execute:
        append("genres", executors.write_genres(plan), ["book"])
    elif args.verb == "rename" and execute:
        moved = staging.staged(executors.move(plan.select(F.col("path").alias("src"), "to")), "renamed")
        append("renames", moved.where("error is null").select(F.col("src").alias("renamed"), "to").join(plan.select(F.col("path").alias("renamed"), "title"), "renamed"), ["renamed"])
    elif args.verb == "undo" and execute:
        staging.staged(executors.undo(plan), "undone")
        staging.staged(executors.prune(spark, args.output), "pruned")
        tables.retire_log(spark, f"{args.output}/moves.log")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
