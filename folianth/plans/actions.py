"""Actions on files as DataFrames: what would be placed, parked, merged, undone. Nothing here touches a file.

A plan row says what to do and in which order; an executor may carry it out per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folianth.functions import columns as C
from folianth.sources.staging import staged

KEPT = ("epub", "pdf")
CONVERTED = ("mobi", "doc", "docx", "rtf", "html", "txt")


def numbered(dest: Column, n: Column) -> Column:
    """The n-th claimant of a name: the first keeps it, later ones get " (n)" before the extension."""
    base, suffix = F.regexp_replace(dest, r"(?<=[^/])\.[^./]*$", ""), F.regexp_extract(dest, r"(?<=[^/])(\.[^./]*)$", 1)
    return F.when(n == 0, dest).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"), suffix))


def unique_destinations(df: DataFrame, dest: str, order: list[str], out: str = "unique_dest") -> DataFrame:
    """Adds ``out``: claimants of one destination in ``order``, numbered from the second on."""
    rank = F.row_number().over(Window.partitionBy(dest).orderBy(*order)) - 1
    return df.withColumn("__n", rank).withColumn(out, numbered(F.col(dest), F.col("__n"))).drop("__n")


def resume(report: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Rows that an earlier run hasn't dealt with."""
    return report.join(done.select(key).distinct(), key, "left_anti")


def ready(min_confidence: float = 0.4) -> Column:
    return (F.col("status") == "ok") & (F.coalesce("author", F.lit("")) != "") & (F.col("confidence") >= min_confidence)


def place(jobs: DataFrame, out_root: str, taken: DataFrame | None = None) -> DataFrame:
    """Plan of (path, original, author, coauthors, title, format): dest, status (done, duplicate, failed), error, action, tag_authors.

    The first job in path order gets the plain name, unless ``taken`` (dest) has it; later ones go to _Duplicates.
    """
    ext = F.when(F.col("format") == "pdf", ".pdf").otherwise(".epub")
    titled = F.when(F.coalesce("title", F.lit("")) != "", C.safe_name(F.concat_ws(" - ", "author", "title"))).otherwise(C.file_stem("path"))
    plan = jobs.withColumn("__folder", C.safe_name("author")).withColumn("__file", F.concat(titled, ext))
    plan = plan.withColumn("__want", F.concat_ws("/", F.lit(out_root), "__folder", "__file"))
    plan = plan.withColumn("__rank", F.row_number().over(Window.partitionBy("__want").orderBy("path")))
    if taken is not None:
        plan = plan.join(taken.select(F.col("dest").alias("__want"), F.lit(True).alias("__there")).distinct(), "__want", "left")
    else:
        plan = plan.withColumn("__there", F.lit(None).cast("boolean"))
    duplicate = F.coalesce("__there", F.lit(False)) | (F.col("__rank") > 1)
    aside = F.concat_ws("/", F.lit(out_root), F.lit("_Duplicates"), "__folder", "__file")
    plan = plan.withColumn("__dest", F.when(duplicate, aside).otherwise(F.col("__want")))
    plan = unique_destinations(plan, "__dest", ["path"], "dest")
    known = F.coalesce(F.col("format").isin(*KEPT, *CONVERTED), F.lit(False))
    return plan.select(
        "path", "original", "author", "coauthors", "title", "format",
        F.when(known, F.col("dest")).alias("dest"),
        F.when(~known, "failed").when(duplicate, "duplicate").otherwise("done").alias("status"),
        F.when(~known, F.concat(F.lit("unsupported format "), F.coalesce("format", F.lit("None")))).alias("error"),
        F.when(~known, "none").when(F.col("format").isin(*KEPT), "copy").otherwise("convert").alias("action"),
        F.concat(F.array("author"), F.coalesce("coauthors", F.array().cast("array<string>"))).alias("tag_authors"),
    )


def all_members_done(members: DataFrame, original: str, done: str) -> DataFrame:
    """(original, complete): whether every member of each original is done."""
    return members.groupBy(original).agg(F.bool_and(done).alias("complete"))


def park(originals: DataFrame, library: str, out_root: str) -> DataFrame:
    """(original, parked): complete originals keep their path below the library, or their name if they lie elsewhere."""
    inside = F.col("original").startswith(library.rstrip("/") + "/")
    below = F.when(inside, F.substring("original", F.lit(len(library.rstrip("/")) + 2), F.length("original"))).otherwise(C.file_name("original"))
    return unique_destinations(originals.withColumn("__p", F.concat_ws("/", F.lit(f"{out_root}/_Originals"), below)), "__p", ["original"], "parked").drop("__p")


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders without a file at any depth, deepest first; Finder's and Explorer's leftovers are no files."""
    real = files.where(~C.file_name("path").isin(".DS_Store", "Thumbs.db"))
    parts = F.split("path", "/")
    above = real.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).distinct()
    depth = F.size(F.split("path", "/"))
    return folders.join(above, "path", "left_anti").withColumn("depth", depth).orderBy(F.desc("depth"), "path")


def undo(log: DataFrame) -> DataFrame:
    """Steps that reverse a log (seq and the entries' fields), newest entry first: move back, restore, remove."""
    back = F.when(F.coalesce("merge", F.lit(False)), F.array(F.struct(F.lit("move").alias("step"), F.col("dest").alias("src"), F.col("from").alias("to"))))
    parked = F.when(F.col("parked").isNotNull(), F.struct(F.lit("restore").alias("step"), F.col("parked").alias("src"), F.col("original").alias("to")))
    placed = F.when(F.col("dest").isNotNull(), F.struct(F.lit("remove").alias("step"), F.col("dest").alias("src"), F.lit(None).cast("string").alias("to")))
    steps = F.coalesce(back, F.filter(F.array(parked, placed), lambda s: s.isNotNull()))
    return log.select("seq", F.posexplode(steps).alias("k", "s")).select("seq", "k", "s.*").orderBy(F.desc("seq"), "k")


def merge_authors(listing: DataFrame, target: str, sources: list[str], out_root: str) -> DataFrame:
    """Moves of every book of the source authors' folders into the target's: from, dest, author, title."""
    folder = C.safe_name(F.lit(target))
    want = [s for s in sources if s != target]
    books = listing.where(C.file_name(C.parent("path")).isin(*want) & F.col("path").rlike(r"\.(epub|pdf)$"))
    stem = F.regexp_replace(C.file_name("path"), r"\.[^.]*$", "")
    at = F.instr(stem, " - ")
    title = F.when(at > 0, F.substring(stem, at + 3, F.length(stem))).otherwise(stem)
    suffix = F.regexp_extract("path", r"(\.[^.]*)$", 1)
    moved = books.select(F.col("path").alias("from"), F.lit(target).alias("author"), title.alias("title"), F.concat(F.lit(out_root + "/"), folder, F.lit("/"), C.safe_name(F.concat(F.lit(target + " - "), title)), suffix).alias("__want"))
    there = moved.join(listing.select(F.col("path").alias("__want"), F.lit(True).alias("__there")), "__want", "left")
    later = F.row_number().over(Window.partitionBy("__want").orderBy("from")) > 1
    aside = F.concat(F.lit(f"{out_root}/_Duplicates/"), folder, F.lit("/"), C.file_name("__want"))
    return unique_destinations(there.withColumn("__late", later).withColumn("__d", F.when(F.col("__late") | F.col("__there"), aside).otherwise(F.col("__want"))), "__d", ["from"], "dest").select("from", "dest", "author", "title")


def merge_origins(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(dest, root): every earlier place of each wanted file, through merges of merges, itself included."""
    moves = log.where("merge").select("dest", F.col("from").alias("src"))
    found = wanted.select(F.col("dest"), F.col("dest").alias("root"))
    frontier = found
    while True:
        step = frontier.join(moves.withColumnRenamed("dest", "root"), "root").select(frontier["dest"], F.col("src").alias("root"))
        frontier = staged(step.join(found, ["dest", "root"], "left_anti").distinct(), "frontier")
        if frontier.isEmpty():
            return found
        found = staged(found.union(frontier), "origins")


def unplace(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(dest, original, parked): what removing a placed copy restores; ``parked`` is the first place where the original was put."""
    roots = merge_origins(log, wanted)
    placed = log.where("dest is not null and original is not null").select(F.col("dest").alias("root"), "original")
    first = log.where("parked is not null").groupBy("original").agg(F.min_by("parked", "seq").alias("parked"))
    return roots.join(placed, "root").select("dest", "original").distinct().join(first, "original", "left").select("dest", "original", "parked")


def renames(listing: DataFrame, title: Column) -> DataFrame:
    """(path, to, title) of books whose name isn't "author - title" yet; ``title`` is worked out from path and author."""
    author = C.file_name(C.parent("path"))
    stem = F.regexp_replace(C.file_name("path"), r"(?<=.)\.[^.]*$", "")
    named = listing.withColumn("author", author).withColumn("title", title)
    want = C.safe_name(F.concat_ws(" - ", "author", "title"))
    changed = named.where((F.coalesce("title", F.lit("")) != "") & (want != stem))
    changed = changed.withColumn("__to", F.concat(C.parent("path"), F.lit("/"), want, F.regexp_extract("path", r"(\.[^.]*)$", 1)))
    return unique_destinations(changed, "__to", ["path"], "to").select("path", "to", "title")
