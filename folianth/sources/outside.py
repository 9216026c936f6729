"""Outside programs, where they are installed: text, tags and archive members of formats that have no reader here.

A file's bytes are written to a scratch folder of the task, the program runs there, and its result is returned; nothing
stays. A program that isn't installed, fails or takes too long is a reason in the row, never an error of the job.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from typing import NamedTuple


class Program(NamedTuple):
    name: str
    formats: tuple[str, ...]  # of the files that it reads; none: of all
    arguments: Callable[[str, str], list[str]]  # of the file and of what it may write
    seconds: int
    output: str = ""  # the ending of the file that it writes; none: it prints


#: Readers of text, the quick ones first.
TEXT = [
    Program("pdftotext", ("pdf",), lambda src, out: ["-l", "5", src, "-"], 60),
    Program("textutil", ("doc", "docx", "rtf", "html"), lambda src, out: ["-convert", "txt", "-stdout", src], 60),
    Program("ebook-convert", (), lambda src, out: [src, out], 180, ".txt"),
]
TAGS = Program("ebook-meta", (), lambda src, out: [src], 60)
UNPACK = Program("unar", ("rar", "7z"), lambda src, out: ["-q", "-f", "-D", "-o", out, src], 300, "/")
TO_DOCX = Program("textutil", ("doc",), lambda src, out: ["-convert", "docx", "-output", out, src], 300, ".docx")


def run(program: Program, src: str, out: str) -> tuple[str, str | None]:
    """(what it printed, why it failed or None)."""
    tool = shutil.which(program.name)
    if not tool:
        return "", f"{program.name} is not installed"
    try:
        done = subprocess.run([tool, *program.arguments(src, out)], capture_output=True, timeout=program.seconds)
    except subprocess.TimeoutExpired:
        return "", f"{program.name} took too long"
    except OSError as e:
        return "", f"{program.name}: {e!r}"[:200]
    said = (done.stderr or done.stdout).decode("utf-8", "ignore").strip()
    missing = program.output and not os.path.exists(out)
    return done.stdout.decode("utf-8", "ignore"), f"{program.name} failed: {said[-200:]}" if done.returncode or missing else None


def text(fmt: str | None, data: bytes, n: int) -> tuple[str | None, str | None]:
    """(the first ``n`` characters, why there are none) by the first installed program that reads the format."""
    able = [p for p in TEXT if (not p.formats or fmt in p.formats) and shutil.which(p.name)]
    if not able:
        return None, f"{fmt} needs an outside reader"
    with tempfile.TemporaryDirectory() as scratch:
        src, out = f"{scratch}/book.{fmt}", f"{scratch}/out{able[0].output}"
        with open(src, "wb") as f:
            f.write(data)
        printed, error = run(able[0], src, out)
        if error:
            return None, error
        if able[0].output:
            with open(out, encoding="utf-8", errors="ignore") as f:
                return f.read(n), None
    return (printed if fmt == "pdf" else " ".join(printed.split()))[:n], None


def tags(fmt: str | None, data: bytes) -> tuple[str | None, str | None, str | None]:
    """title, authors, tags as the metadata program prints them; nulls without it."""
    if fmt in (None, "doc", "txt") or not shutil.which(TAGS.name):
        return None, None, None
    with tempfile.TemporaryDirectory() as scratch:
        src = f"{scratch}/book.{fmt}"
        with open(src, "wb") as f:
            f.write(data)
        printed, _ = run(TAGS, src, "")
    fields = {k.strip(): v.strip() for k, colon, v in (line.partition(":") for line in printed.splitlines()) if colon}
    authors = re.sub(r"\s*\[[^\]]*\]", "", fields.get("Author(s)", ""))  # the name to sort by
    return fields.get("Title") or None, authors or None, fields.get("Tags") or None


def members(fmt: str | None, data: bytes) -> list[tuple[str, bytes]]:
    """(path, content) of an archive's files by path; none where it can't be unpacked."""
    if fmt not in UNPACK.formats or not shutil.which(UNPACK.name):
        return []
    found = []
    with tempfile.TemporaryDirectory() as scratch:
        src, out = f"{scratch}/archive.{fmt}", f"{scratch}/out"
        with open(src, "wb") as f:
            f.write(data)
        os.mkdir(out)
        run(UNPACK, src, out)
        for folder, _, names in os.walk(out):
            for name in names:
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    found.append((os.path.relpath(path, out), f.read()))
    return sorted(found)
