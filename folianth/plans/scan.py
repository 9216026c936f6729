"""The verbs: scan, apply, genres, rename, harmonize, undo. Each takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianth.functions import columns as C
from folianth.functions import fixed
from folianth.operators import genres as G
from folianth.operators import matching as M
from folianth.operators import titles
from folianth.operators import voting as V
from folianth.plans import actions
from folianth.sources.staging import few_bytes, spread, staged


def _all_names(decided: DataFrame) -> DataFrame:
    """name, place of authors and coauthors, in path order."""
    people = F.filter(F.concat(F.array("decision.author"), F.coalesce("decision.coauthors", F.array().cast("array<string>"))), lambda n: n.isNotNull())
    return decided.select("path", F.posexplode(people).alias("k", "name")).select("name", F.struct("path", "k").alias("place"))


def scan(books: DataFrame, answers: DataFrame | None = None, picks: DataFrame | None = None, overrides: DataFrame | None = None, given: DataFrame | None = None, threshold: float = fixed.THRESHOLD, anthologies: bool = False) -> DataFrame:
    """Who wrote each book: a report row per book.

    ``books``: path, archive, format, title, authors, snippet. ``answers`` and ``picks`` (path, answer) are
    what a language model says, looked up only where the plain sources disagree, or two clusters stay
    close. ``overrides``: rule_pos, from, to, kind. ``given``: further given names (given).

    The priors of the library and the given names stay those of the first vote, as the order of the
    stages is part of the result; the order of words also counts the model's answers, not its picks.
    """
    spark = books.sparkSession
    records = staged(V.prune_folders(V.gather(books)), "records")
    named = V.mentions(records)
    seed = V.seed_names(spark) if given is None else V.seed_names(spark).union(given.select("given")).distinct()
    trusted = staged(V.given_names(named, seed), "given")
    small = few_bytes(records)  # then the joins below leave a partition or two, and the vote is Python
    mentioned = records.select(F.col("path").alias("book"), F.transform("candidates", lambda c: C.key(c["name"])).alias("keys"))
    ready = V.with_priors(records, V.books_by_key(mentioned), trusted)
    records = V.decide(spread(ready, "path") if small else ready)
    if answers is not None:
        records = V.decide(V.add_answers(staged(records, "first-vote"), answers, "llm", ~V.settled()))
    records = staged(records, "votes")
    order = M.order_prior(V.mentions(records))
    if picks is not None:
        unsure = (F.col("decision.confidence") < threshold) & (F.size("decision.candidates") > 1)
        records = V.decide(V.add_answers(records, picks, "llmpick", unsure))
    suspect = V.caps_suspect_udf("decision.author", "path", "archive", "snippet", "candidates", "name_parts")
    records = records.withColumn("confidence", F.when(suspect, F.least(F.lit(0.3), "decision.confidence")).otherwise(F.col("decision.confidence")))
    records = records.withColumn("sources", F.col("decision.sources"))
    if anthologies:
        many = V.is_anthology(F.coalesce("archive", "path"), F.col("title"), F.col("authors"), F.col("snippet"))
        alone = F.struct(
            F.lit(fixed.ANTHOLOGY_AUTHOR).alias("author"), F.lit(1.0).alias("confidence"), F.array(F.lit("anthology")).alias("sources"),
            F.col("decision.candidates").alias("candidates"), F.array().cast("array<string>").alias("coauthors"),
        )
        records = records.withColumn("__many", many).withColumn("decision", F.when(F.col("__many"), alone).otherwise(F.col("decision")))
        records = records.withColumn("confidence", F.when(F.col("__many"), 1.0).otherwise(F.col("confidence"))).withColumn("sources", F.when(F.col("__many"), F.array(F.lit("anthology"))).otherwise(F.col("sources"))).drop("__many")
    records = staged(records, "decisions")
    return _report(records, trusted, order, overrides, threshold)


def _report(records: DataFrame, trusted: DataFrame, order: DataFrame, overrides: DataFrame | None, threshold: float) -> DataFrame:
    canonical = staged(M.canonical_spellings(_all_names(records)), "canonical")
    # One lookup of a name serves authors and coauthors: canonical spelling, order of words, override.
    shown = M.fix_order(canonical, "canonical", trusted, order, "shown").select("name", "shown")
    if overrides is not None:
        rules = overrides.where("kind = 'name'")
        forced = M.override_names(shown.select(F.col("shown").alias("name")), rules).select(F.col("name").alias("shown"), "to")
        shown = shown.join(forced, "shown", "left").select("name", F.coalesce("to", "shown").alias("shown"))
    shown = staged(shown, "shown")
    out = records.join(shown.select(F.col("name").alias("__a"), F.col("shown").alias("author")), F.col("decision.author") == F.col("__a"), "left").drop("__a")
    others = records.select("path", F.posexplode("decision.coauthors").alias("k", "name")).join(shown, "name").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "shown"))), lambda x: x["shown"]).alias("coauthors"))
    out = out.join(others, "path", "left").withColumn("coauthors", F.coalesce("coauthors", F.array().cast("array<string>")))
    where = F.coalesce("archive", "path")
    if overrides is not None:
        rules = [(r["from"], r["to"]) for r in overrides.where("kind = 'file'").orderBy("rule_pos").collect()]
        out = M.override_files(out, where, rules)
        out = out.withColumn("author", F.coalesce("forced", "author")).withColumn("confidence", F.when(F.col("forced").isNotNull(), 1.0).otherwise(F.col("confidence")))
        out = out.withColumn("sources", F.when(F.col("forced").isNotNull(), F.array(F.lit("override"))).otherwise(F.col("sources")))
    title = titles.title(F.col("path"), F.col("archive"), F.col("title"), F.array("author", "decision.author"), F.col("decision.coauthors"))
    ok = F.col("author").isNotNull() & (F.col("confidence") >= threshold)
    return out.select(
        "path", "archive", "author", "coauthors", title.alias("title"), "confidence", "sources",
        F.col("decision.candidates").alias("candidates"), F.when(ok, "ok").otherwise("review").alias("status"), "format",
    )


def summary(report: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    return report.agg(F.count("*").alias("books"), F.count_if(F.col("confidence") >= threshold).alias("confident"), F.count_distinct("author").alias("authors"))


def apply(report: DataFrame, log: DataFrame | None, existing: DataFrame, out_root: str, min_confidence: float = fixed.THRESHOLD, limit: int | None = None) -> DataFrame:
    """The plan that places the confident books that no earlier run has placed; ``existing`` (path) is what the output holds."""
    jobs = report.where(actions.ready(min_confidence)).withColumn("original", F.coalesce("archive", "path"))
    if log is not None:
        from folianth.sources.tables import placed_sources

        jobs = actions.resume(jobs, placed_sources(log, existing))
    if limit:
        jobs = jobs.orderBy("path").limit(limit)
    return actions.place(jobs, out_root, existing.select(F.col("path").alias("dest")))


def parkable(report: DataFrame, placed: DataFrame, library: str, out_root: str) -> DataFrame:
    """(original, parked) of originals all of whose books have been placed."""
    members = report.select("path", F.coalesce("archive", "path").alias("original"))
    done = members.join(placed.select("path", F.lit(True).alias("done")), "path", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return actions.park(actions.all_members_done(done, "original", "done").where("complete").select("original"), library, out_root)


def genres(books: DataFrame, log: DataFrame | None, answers: DataFrame, author: str | None = None, limit: int | None = None, retag: bool = False, most: int = 3) -> DataFrame:
    """book, genres, old_tags, hint of placed books (path, tags) without genres yet; ``answers``: path, pos, answer."""
    left = books.withColumnRenamed("path", "book")
    if log is not None and not retag:
        left = left.join(log.select("book").distinct(), "book", "left_anti")
    if author:
        left = left.where(F.contains(F.lower(C.file_name(C.parent("book"))), F.lit(author.lower())))
    if limit:
        left = left.orderBy("book").limit(limit)
    chosen = G.choose(answers.withColumnRenamed("path", "book"), "book", most)
    return left.join(chosen, "book", "left").select("book", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), F.coalesce("tags", F.lit("")).alias("old_tags"), C.collection_hint("tags").alias("hint"))


def harmonize(log: DataFrame, existing: DataFrame) -> DataFrame:
    """book, genres, old_tags, harmonized: log entries of books whose genres change to match their copies, series and author."""
    last = G.latest(log, "book", "seq").join(existing.select(F.col("path").alias("book")), "book", "left_semi")
    return G.harmonize(last.select("book", "genres")).where("genres <> before").select("book", "genres", F.array_join("before", ", ").alias("old_tags"), F.lit(True).alias("harmonized"))


def rename(placed: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, to, title) of placed books (path) whose file name isn't their clean title."""
    books = placed.orderBy("path").limit(limit) if limit else placed
    author = F.col("author")
    stem = F.regexp_replace(C.file_name("path"), r"(?<=.)\.[^.]*$", "")
    at = F.instr(stem, " - ")
    current = F.when(stem.startswith(F.concat(author, F.lit(" - "))) & (at > 0), F.substring(stem, at + 3, F.length(stem))).otherwise(stem)
    return actions.renames(books, titles.title(F.col("path"), F.lit(None).cast("string"), current, F.array(author)))


def undo(log: DataFrame) -> DataFrame:
    return actions.undo(log)


def ask(records: DataFrame, provider, schema: str = "path string, answer string") -> DataFrame:
    """Answers of ``provider`` (an iterator of pandas frames to an iterator of them): run it only on the rows to be asked."""
    return records.mapInPandas(provider, schema)


def verbs() -> Iterable[str]:
    return ("scan", "apply", "genres", "rename", "harmonize", "undo")
