"""Genre answers onto the taxonomy, hints of collections, and genres that copies, series and authors share."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianth.functions import columns as C
from folianth.functions import fixed
from folianth.functions.text import fold


def taxonomy(spark: SparkSession, genres: list[str] | None = None) -> DataFrame:
    """pos, genre."""
    return spark.createDataFrame(list(enumerate(genres or fixed.GENRES)), "pos int, genre string")


def _norm(s: str) -> str:
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in fold(s)).split())


def match_genre(answer: Column, genres: list[str] | None = None) -> Column:
    """The genre that an answer means: by name, by alias, else the closest name (0.85 alike at least); or null.

    Taxonomy and aliases are fixed short lists, so the first two are map lookups in the row; only what
    they leave goes to Python.
    """
    genres = genres or fixed.GENRES
    exact = dict(reversed([(_norm(g), g) for g in genres]))
    table = {k: v for k, v in (fixed.GENRE_ALIASES | exact).items()}
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    names = list(exact)

    @F.pandas_udf(T.StringType())
    def closest(norm: pd.Series) -> pd.Series:
        def one(s):
            found = difflib.get_close_matches(s, names, n=1, cutoff=0.85) if s else []
            return exact[found[0]] if found else None

        return norm.map(one)

    norm = C.genre_norm(answer)
    known = F.try_element_at(lookup, norm)
    # A Python function is evaluated whatever the branch, so it gets null where the lookup has an answer.
    return F.coalesce(known, closest(F.when(known.isNull(), norm)))


def choose(answers: DataFrame, book: str = "book", most: int = 3, genres: list[str] | None = None) -> DataFrame:
    """(book, genres) from (book, pos, answer): distinct genres in order, ``most`` at most; the last resort only when alone."""
    matched = answers.withColumn("genre", match_genre(F.col("answer"), genres)).where(F.col("genre").isNotNull())
    lists = matched.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("pos", "genre"))).alias("l"))
    first = F.slice(F.array_distinct("l.genre"), 1, most)
    specific = F.filter(first, lambda g: g != fixed.LAST_RESORT_GENRE)
    return lists.select(book, F.when(F.size(specific) > 0, specific).otherwise(first).alias("genres"))


def frequency(tagged: DataFrame, top: int = 8) -> DataFrame:
    """genre, n: the most frequent genres, ties by name."""
    return tagged.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(top)


def _shared(df: DataFrame, group: list[str], least: int) -> DataFrame:
    """Books of groups of ``least`` or more take the three genres most frequent in the group; ties go to the name."""
    sized = df.groupBy(*group).agg(F.count("*").alias("__n")).where((F.col("__n") >= least) & F.col(group[-1]).isNotNull())
    counts = df.where(F.col(group[-1]).isNotNull()).select(*group, F.explode("genres").alias("g")).groupBy(*group, "g").agg(F.count("*").alias("k"))
    # The taxonomy bounds what is collected of a group.
    top = counts.groupBy(*group).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "g"))), lambda x: x["g"]), 1, 3).alias("__top"))
    merged = sized.join(top, group, "left").select(*group, F.coalesce("__top", F.array().cast("array<string>")).alias("__top"))
    return df.join(merged, group, "left").withColumn("genres", F.coalesce("__top", "genres")).drop("__top")


def share_by_author(df: DataFrame, author: str = "author", least: int = 3, part: float = 0.6) -> DataFrame:
    """A genre on max(2, part of the author's books) joins the others' lists, which stay at three; in order of frequency, then name."""
    sized = df.groupBy(author).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    counts = df.select(author, F.explode(F.array_distinct("genres")).alias("g")).groupBy(author, "g").agg(F.count("*").alias("k"))
    common = counts.join(sized, author).where(F.col("k") >= F.greatest(F.lit(2.0), part * F.col("__n")))
    lists = common.groupBy(author).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "g"))), lambda x: x["g"]).alias("__common"))
    more = F.slice(F.concat("genres", F.array_except("__common", "genres")), 1, 3)
    return df.join(lists, author, "left").withColumn("genres", F.when(F.col("__common").isNotNull(), more).otherwise(F.col("genres"))).drop("__common")


def harmonize(tagged: DataFrame) -> DataFrame:
    """book, before, genres from (book, genres): copies of one book agree, then volumes of a series, then an author's shelf."""
    df = tagged.select("book", F.col("genres").alias("before"), "genres", C.file_name(C.parent("book")).alias("author"), F.regexp_replace(C.file_name("book"), r"(?<=.)\.[^.]*$", "").alias("stem"))
    df = df.withColumn("copy", C.fold("stem")).withColumn("series", C.series_key("author", "stem")["series"])
    df = _shared(_shared(df, ["author", "copy"], 2), ["author", "series"], 2)
    return share_by_author(df).select("book", "before", "genres")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key of an append-only log."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
