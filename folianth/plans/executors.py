"""Carrying plans out on a file system that every worker mounts. Optional: a plan is complete without it.

Each row is tried alone; what fails is an ``error`` in its row. Results are a table, so a log can be appended
per partition and a run that stops midway loses no record of what it did.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folianth.operators.components import components
from folianth.sources import files, outside

DONE = "path string, original string, dest string, status string, error string, tag_error string"
#: Endings by which the converter knows a format.
ENDINGS = {
    "mobi": (".mobi", ".azw", ".azw3", ".prc"), "docx": (".docx",), "rtf": (".rtf",), "html": (".html", ".htm"), "txt": (".txt",),
}
CONVERT = outside.Program("ebook-convert", (), lambda src, out: [src, out], 900, ".epub")


def _tagger(*arguments: str) -> outside.Program:
    return outside.Program("ebook-meta", (), lambda src, out: [src, *arguments], 120)


def convert(src: str, dest: str, fmt: str | None = None) -> str | None:
    """Write an epub of ``src`` to ``dest``, or the reason why not.

    doc becomes docx first; a file whose ending hides its format is copied under one that tells it. What the converter
    wrote is checked before it is moved to its place.
    """
    ending = os.path.splitext(src)[1].lower()
    with tempfile.TemporaryDirectory() as scratch:
        source, made = src, f"{scratch}/made.epub"
        if fmt == "doc":
            source = f"{scratch}/book.docx"
            if error := outside.run(outside.TO_DOCX, src, source)[1]:
                return error
        elif fmt in ENDINGS and ending not in {x for of in ENDINGS.values() for x in of}:
            source = shutil.copy2(src, f"{scratch}/book{ENDINGS[fmt][0]}")
        if error := outside.run(CONVERT, source, made)[1]:
            return error
        with open(made, "rb") as f:
            if problem := files.problem_of(f.read()):
                return f"the converted book is {problem}" if problem == "damaged" else f"the converted book: {problem}"
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        shutil.move(made, dest)
    return None


def tag(dest: str, authors: list[str], title: str | None) -> str | None:
    return outside.run(_tagger("--authors", " & ".join(authors), *(["--title", title] if title else [])), dest, "")[1]


def tag_genres(dest: str, genres: list[str]) -> str | None:
    return outside.run(_tagger("--tags", ", ".join(genres)), dest, "")[1]


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def place(plan: DataFrame, convert: Callable[[str, str, str | None], str | None] = convert, tag: Callable[[str, list[str], str | None], str | None] = tag) -> DataFrame:
    """Copies or converts each row of ``actions.place``; existing files are never overwritten."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                error, tagged = r.error if r.action == "none" else None, None
                try:
                    if not error:
                        dest = _local(r.dest)
                        if os.path.exists(dest):
                            error = "the destination exists"
                        else:
                            os.makedirs(os.path.dirname(dest), exist_ok=True)
                            error = convert(_local(r.path), dest, r.format) if r.action == "convert" else (shutil.copy2(_local(r.path), dest), None)[1]
                            tagged = None if error else tag(dest, list(r.tag_authors), r.title)
                except Exception as e:
                    error = repr(e)[:200]
                out.append((r.path, r.original, None if error else r.dest, "failed" if error else r.status, error, tagged))
            yield pd.DataFrame(out, columns=["path", "original", "dest", "status", "error", "tag_error"])

    return plan.mapInPandas(run, DONE)


def move(steps: DataFrame) -> DataFrame:
    """Moves (src, to) one by one, never over an existing file: src, to, error."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for src, to in zip(frame["src"], frame["to"]):
                error = None
                try:
                    if os.path.exists(_local(to)):
                        error = "the destination exists"
                    else:
                        os.makedirs(os.path.dirname(_local(to)), exist_ok=True)
                        shutil.move(_local(src), _local(to))
                except Exception as e:
                    error = repr(e)[:200]
                out.append((src, to, error))
            yield pd.DataFrame(out, columns=["src", "to", "error"])

    return steps.select("src", "to").mapInPandas(run, "src string, to string, error string")


def write_genres(plan: DataFrame, write: Callable[[str, list[str]], str | None] = tag_genres) -> DataFrame:
    """Writes the genres of each row of a genre plan into its book: the plan's columns and ``error``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            def one(book, genres):
                try:
                    return write(_local(book), list(genres)) if len(genres) else "no genre"
                except Exception as e:
                    return repr(e)[:200]

            yield frame.assign(error=[one(b, g) for b, g in zip(frame["book"], frame["genres"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema.fields)
    return plan.mapInPandas(run, f"{fields}, error string")


def prune(spark: SparkSession, root: str) -> DataFrame:
    """Removes folders below ``root`` that hold no file, leftovers of file managers aside: removed (path), deepest first in each top folder; tops go side by side, ``root`` stays."""
    tops = spark.createDataFrame([(x.path,) for x in os.scandir(_local(root)) if x.is_dir(follow_symlinks=False)], "top string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            removed = []
            for top in frame["top"]:
                for folder, _, _ in os.walk(top, topdown=False):
                    names = os.listdir(folder)
                    if all(n in (".DS_Store", "Thumbs.db") for n in names):
                        for n in names:
                            os.unlink(os.path.join(folder, n))
                        os.rmdir(folder)
                        removed.append(folder)
            yield pd.DataFrame({"removed": removed}, dtype=object)

    return tops.repartition("top").mapInPandas(run, "removed string")


def undo(steps: DataFrame, tag: Callable[[str, list[str], str | None], str | None] = tag) -> DataFrame:
    """Carries out ``actions.undo``: seq, step, src, to, error.

    Steps that touch one file, through any number of moves, go to one task and run there newest first; others go side by
    side. A file is never put over another one, and what is gone already is left alone.
    """
    links = steps.select(F.col("src").alias("a"), F.coalesce("to", "src").alias("b"))
    tied = components(links).withColumnRenamed("node", "__node")
    grouped = steps.join(tied, steps["src"] == tied["__node"], "left").withColumn("__root", F.coalesce("root", "src")).drop("__node", "root")
    ordered = grouped.repartition("__root").sortWithinPartitions("__root", F.desc("seq"), "k")

    def one(step: str, src: str, to: str | None) -> str | None:
        if not os.path.exists(src):
            return "it is gone"
        if step == "remove":
            os.unlink(src)
            return None
        if os.path.exists(to):
            return "the destination exists"
        os.makedirs(os.path.dirname(to), exist_ok=True)
        shutil.move(src, to)
        if step == "move":  # a merge: the tags name the author whose folder it is back in
            name = os.path.splitext(os.path.basename(to))[0]
            return tag(to, [os.path.basename(os.path.dirname(to))], name.split(" - ", 1)[-1])
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = []
            for step, src, to in zip(frame["step"], frame["src"], frame["to"]):
                try:
                    errors.append(one(step, _local(src), to and _local(to)))
                except Exception as e:
                    errors.append(repr(e)[:200])
            yield frame[["seq", "step", "src", "to"]].assign(error=errors)

    return ordered.select("seq", "step", "src", "to").mapInPandas(run, "seq bigint, step string, src string, to string, error string")
