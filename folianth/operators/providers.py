"""Language models as providers: what is asked of them, and their JSON replies as columns.

A provider is any function over an iterator of pandas frames (path, prompt) that yields (path, reply); it runs
only on the rows handed to it, throttled by their number of partitions. A failed call leaves a null reply and an
``error``, apart from "no answer", so that it may be asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTHOR_CHARS, CHOICE_CHARS, GENRE_CHARS = 3000, 2500, 1500

AUTHOR = "Name the author of this book as JSON with the key author, or null if the evidence doesn't tell.\nFile: %s\nFolder: %s\nTitle tag: %s\nAuthor tag: %s\nText: %s"
CHOICE = "One of these may be the author of the book. Answer as JSON with the key choice: its number, or null.\nFile: %s\n%s\nText: %s"
GENRE = "Choose one to three genres of the list for this book, as JSON with the key genres.\nAuthor: %s\nTitle: %s\nTags: %s\n%s\nText: %s\nGenres:\n%s"


def _text(c: Column, n: int) -> Column:
    return F.coalesce(F.nullif(F.substring(c, 1, n), F.lit("")), F.lit("(none)"))


def author_prompt(path: Column, folder: Column, title: Column, authors: Column, snippet: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.format_string(AUTHOR, path, folder, blank(title), blank(authors), _text(snippet, AUTHOR_CHARS))


def choice_prompt(path: Column, options: Column, snippet: Column) -> Column:
    listed = F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")
    return F.format_string(CHOICE, path, listed, _text(snippet, CHOICE_CHARS))


def genre_prompt(author: Column, title: Column, tags: Column, hint: Column, snippet: Column, genres: list[str]) -> Column:
    told = F.when(hint != "", F.concat(F.lit("It comes from a collection of "), hint, F.lit(", which may hold other genres."))).otherwise("")
    return F.format_string(GENRE, author, title, F.coalesce(tags, F.lit("")), told, _text(snippet, GENRE_CHARS), F.lit("\n".join(genres)))


def ask(prompts: DataFrame, provider: Callable[[str], str], at_once: int = 2) -> DataFrame:
    """path, reply, error from (path, prompt), ``at_once`` calls at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, prompt in zip(frame["path"], frame["prompt"]):
                try:
                    rows.append((path, provider(prompt), None))
                except Exception as e:  # one failed call is a row, not the end of the run
                    rows.append((path, None, repr(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "reply", "error"])

    return prompts.select("path", "prompt").repartition(at_once).mapInPandas(run, "path string, reply string, error string")


def author_of(reply: Column) -> Column:
    """The author named, trimmed; null for none and for replies that aren't such JSON."""
    return F.nullif(F.trim(F.from_json(reply, "author string")["author"]), F.lit(""))


def choice_of(reply: Column, options: Column) -> Column:
    """The option whose number, from 1, was answered; numbers beyond the options choose nothing."""
    n = F.from_json(reply, "choice string")["choice"].try_cast("int")
    return F.when((n >= 1) & (n <= F.size(options)), F.get(options, n - 1))


def genres_of(reply: Column) -> Column:
    """array<string> of the answers under genres or genre, be it a list or one string; empty for other replies."""
    lists = F.from_json(reply, "genres array<string>, genre array<string>")
    single = F.from_json(reply, "genres string, genre string")
    one = F.coalesce(single["genres"], single["genre"])
    several = F.coalesce(F.when(F.size(lists["genres"]) > 0, lists["genres"]), F.when(F.size(lists["genre"]) > 0, lists["genre"]))
    alone = F.when(one.isNotNull() & ~one.startswith("["), F.array(one))
    return F.filter(F.coalesce(several, alone, F.array().cast("array<string>")), lambda g: g.isNotNull())


def answers(replies: DataFrame) -> DataFrame:
    """path, pos, answer of genre replies (path, reply)."""
    return replies.select("path", F.posexplode(genres_of(F.col("reply"))).alias("pos", "answer"))
