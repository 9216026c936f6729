"""From books to decisions: gathering evidence, library-wide priors, and the vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianth.functions import columns as C
from folianth.functions import voting as V
from folianth.functions.evidence import gather as gather_one
from folianth.functions.rowwise import rowwise
from folianth.functions.text import FIRST_NAMES, any_same, fold, latin, occurs, without_credits, words_of
from folianth.functions import fixed
from folianth.functions.evidence import stem
from folianth.sources.staging import staged

_strings = T.ArrayType(T.StringType())
# Objects, not type strings: workers import this module and have no session to parse with.
CANDIDATES = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("name", T.StringType())]))
EVIDENCE = T.StructType([T.StructField("title_used", T.StringType()), T.StructField("candidates", CANDIDATES), T.StructField("name_parts", T.IntegerType()), T.StructField("groups", T.ArrayType(_strings))])
RANKED = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType())]))
DECISION = T.StructType([T.StructField("author", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("sources", _strings), T.StructField("candidates", RANKED), T.StructField("coauthors", _strings)])


@rowwise(EVIDENCE)
def _gather(*book):
    g = gather_one(*book)
    return {"title_used": g["title"], "candidates": [{"source": s, "name": n} for s, n in g["candidates"]], "name_parts": g["name_parts"], "groups": g["groups"]}


def gather(books: DataFrame) -> DataFrame:
    """Books (path, archive, format, title, authors, snippet; llm if an answer is there at once) with their candidates."""
    llm = F.col("llm") if "llm" in books.columns else F.lit(None).cast("string")
    made = books.withColumn("e", _gather("path", "archive", "format", "title", "authors", "snippet", llm))
    return made.select(*books.columns, "e.title_used", "e.candidates", "e.name_parts", "e.groups")


@rowwise(T.BooleanType())
def _agrees(candidates, snippet):
    folder = [c["name"] for c in candidates if c["source"] == "folder"]
    if not folder:
        return False
    others = [c["name"] for c in candidates if c["source"] in ("filename", "tags", "pdftags", "impressum")]
    return any_same(folder[0], others) or occurs(folder[0], words_of(without_credits(fold(snippet))))


def folder_vote(df: DataFrame, group: str, has_folder: str, agrees: str) -> DataFrame:
    """(group, n, agree, keep): a folder names an author if half of its books, and one at least, agree."""
    counted = df.where(has_folder).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(agrees)).alias("agree"))
    return counted.withColumn("keep", F.col("agree") >= F.greatest(F.lit(1.0), F.col("n") / 2.0))


def prune_folders(records: DataFrame) -> DataFrame:
    """Candidates without the folder's name where the folder's books don't agree with it."""
    marked = records.withColumn("__dir", C.parent("path")).withColumn("__has", F.exists("candidates", lambda c: c["source"] == "folder")).withColumn("__agrees", _agrees("candidates", "snippet"))
    kept = folder_vote(marked, "__dir", "__has", "__agrees").select("__dir", "keep")
    out = marked.join(kept, "__dir", "left")
    pruned = F.filter("candidates", lambda c: c["source"] != "folder")
    return out.withColumn("candidates", F.when(F.col("keep") | ~F.col("__has"), F.col("candidates")).otherwise(pruned)).drop("__dir", "__has", "__agrees", "keep")


def mentions(records: DataFrame) -> DataFrame:
    """path, source, name, place of every candidate."""
    return records.select("path", F.posexplode("candidates").alias("place", "c")).select("path", "c.source", "c.name", "place")


def books_by_key(listed: DataFrame) -> DataFrame:
    """key, n: books that hold each key, from rows of (book, keys).

    Keys of a book that has one row are made distinct in it, so they are only added up; no pair of book and key is dealt
    out. Those of books with several rows, whose ids are found beforehand, are.
    """
    several = staged(listed.groupBy("book").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("book").alias("again")), "several")
    told = listed.join(several.withColumn("__yes", F.lit(True)), F.col("book").eqNullSafe(F.col("again")), "left")
    pairs = told.select(F.when(F.col("__yes"), F.struct("book")).alias("shared"), F.explode(F.array_distinct("keys")).alias("key"))
    counted = pairs.groupBy("shared", "key").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.sum(F.when(F.col("shared").isNull(), F.col("n")).otherwise(1)).alias("n"))


def library_prior(named: DataFrame, book: str = "path", spelling: str = "name") -> DataFrame:
    """key, n: books that mention each name, in any order of its words."""
    return books_by_key(named.select(F.col(book).alias("book"), F.array(C.key(spelling)).alias("keys")))


def given_names(named: DataFrame, seed: DataFrame) -> DataFrame:
    """given: the seed, and the first words of folder names whose last word isn't one of the seed."""
    folders = named.where("source = 'folder'").select("name").distinct()
    last = folders.withColumn("given", C.fold(F.element_at(F.split("name", r"\s+"), -1)))
    trusted = last.join(seed, "given", "left_anti").select(C.first_name("name").alias("given"))
    return seed.union(trusted).where("given <> ''").distinct()


def seed_names(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in sorted(FIRST_NAMES)], "given string")


@rowwise(DECISION)
def _decide(candidates, snippet, title, groups, known, given):
    d = V.decide([(c["source"], c["name"]) for c in candidates], snippet, dict.fromkeys(known, 3), title, frozenset(given), groups)
    return d | {"candidates": [{"name": n, "score": s} for n, s in d["candidates"]]}


def with_priors(records: DataFrame, prior: DataFrame, given: DataFrame) -> DataFrame:
    """Adds what each record's names find in the priors: ``known_keys`` (in three books or more) and ``known_given``.

    Equi-joins on the names; nothing that grows with the library is broadcast.
    """
    names = records.select("path", F.explode(F.array_union(F.transform("candidates", lambda c: c["name"]), F.flatten("groups"))).alias("name"))
    keyed = names.select("path", C.tokens("name").alias("t")).select("path", C.key_of("t").alias("key"), C.first_of("t").alias("given"))
    keys = keyed.join(prior.where("n >= 3").select("key"), "key", "left_semi").groupBy("path").agg(F.collect_set("key").alias("known_keys"))
    trusted = keyed.join(given, "given", "left_semi").groupBy("path").agg(F.collect_set("given").alias("known_given"))
    out = records.join(keys, "path", "left").join(trusted, "path", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("known_keys", F.coalesce("known_keys", none)).withColumn("known_given", F.coalesce("known_given", none))


def decide(records: DataFrame) -> DataFrame:
    """Adds ``decision`` to records with priors."""
    return records.withColumn("decision", _decide("candidates", "snippet", "title_used", "groups", "known_keys", "known_given"))


def settled(decision: str = "decision"):
    strong = F.array(*map(F.lit, fixed.STRONG))
    return (F.size(F.array_intersect(f"{decision}.sources", strong)) >= 3) & (F.col(f"{decision}.confidence") >= 0.6)


def add_answers(records: DataFrame, answers: DataFrame, source: str, ask) -> DataFrame:
    """Appends the provider's answer (path, answer) as candidates of ``source`` where ``ask`` holds; a null answer is no candidate."""
    a = answers.where(F.col("answer").isNotNull()).groupBy("path").agg(F.min("answer").alias("__a"))
    out = records.join(a, "path", "left")
    shown = C.tidy_name("__a") if source == "llm" else F.col("__a")
    fits = C.is_name("__a") if source == "llm" else F.exists(F.slice("decision.candidates", 1, 6), lambda c: c["name"] == F.col("__a"))
    named = F.array(F.struct(F.lit(source).alias("source"), shown.alias("name")))
    kept = F.filter("candidates", lambda c: c["source"] != source)
    return out.withColumn("candidates", F.when(ask & F.coalesce(fits, F.lit(False)), F.concat(kept, named)).otherwise(F.col("candidates"))).drop("__a")


def caps_suspect(author: str | None, path: str, archive: str | None, snippet: str | None, candidates, name_parts: int) -> bool:
    """A lone one-part file name that looks like the title: lower case, or printed in capitals at the start of the book."""
    of = lambda *sources: [c["name"] for c in candidates if c["source"] in sources]
    named = of("filename")
    if not author or name_parts > 1 or len(named) != 1 or not any_same(author, named) or any_same(author, of("folder", "impressum", "swappedtags")):
        return False
    raw = stem(archive or path)
    if raw.lower() == raw and not any_same(author, of("tags", "pdftags")):
        return True
    head = latin((snippet or "")[:300])
    own = {fold(w) for w in author.split()}
    return author.upper() in head.upper() and any(len(w) > 2 and w.isupper() and fold(w) in own for w in head.split())


caps_suspect_udf = rowwise(T.BooleanType())(caps_suspect)


def is_anthology(path, title, authors, snippet):
    """Many writers: by words of the title, a "various" tag, or a table of contents that names three or more."""
    words = "(?Uiu)" + fixed.ANTHOLOGY
    head = F.substring(C.latin(F.coalesce(snippet, F.lit(""))), 1, 3000)
    toc = F.regexp_extract(head, "(?U)" + fixed.CONTENTS, 1)
    listed = F.array_distinct(F.transform(F.regexp_extract_all(toc, F.lit("(?U)" + fixed.CONTENTS_NAME), F.lit(1)), C.fold))
    tags = F.trim(C.fold(F.coalesce(authors, F.lit("")))).isin(*fixed.ANTHOLOGY_TAGS)
    return C.latin(C.stem(path)).rlike(words) | C.latin(F.coalesce(title, F.lit(""))).rlike(words) | tags | (F.size(listed) >= 3)


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """status, n: how many rows of a plan or a log have each status."""
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def accuracy(scored: DataFrame, right: str, sure: str) -> DataFrame:
    """n, share right, how many are confident, share of those that are right."""
    return scored.agg(
        F.count("*").alias("n"), F.avg(F.col(right).cast("int")).alias("accuracy"), F.count_if(F.col(sure)).alias("confident"),
        F.avg(F.when(F.col(sure), F.col(right).cast("int"))).alias("confident_accuracy"),
    )
