"""Files as tables: formats by content, archive members, and the leading text of books.

``read_files`` brings whole files (binaryFile); everything else is a column or an Arrow function over ``content``.
Formats that need outside programs (pdf, doc, rtf; rar and 7z archives) are read by those that are installed (``outside``);
else they give a null text and an ``error``, and their text may be joined in as a table.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianth.functions import columns as C
from folianth.functions import fixed
from folianth.sources import outside

TEXT_CHARS = 5000
#: Spine documents of an epub, and text records of a mobi, that the leading text is taken from.
SPINE_DOCS = 8
MOBI_RECORDS = 6
#: Bytes in which a text file must not hold a NUL.
HEAD = 4096


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of every file under ``root``; ``pattern`` is a glob on file names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)


def file_key(path: Column, length: Column, modified: Column) -> Column:
    """Names a state of a file: path, size and time in whole seconds."""
    return F.concat_ws("|", path, length.cast("string"), F.unix_timestamp(modified).cast("string"))


def archive_tag(path: Column, length: Column, modified: Column) -> Column:
    return F.substring(F.sha1(file_key(path, length, modified)), 1, 16)


def _open(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def _zip_kind(content: pd.Series) -> pd.Series:
    def one(data):
        z = None if data is None else _open(bytes(data))
        if z is None:
            return None
        names = set(z.namelist())
        try:
            if "mimetype" in names and b"epub" in z.read("mimetype"):
                return "epub"
        except (zipfile.BadZipFile, RuntimeError, zlib.error, OSError):
            return None
        return "docx" if "word/document.xml" in names else "zip"

    return content.map(one)


def detect(path: Column | str = "path", content: Column | str = "content") -> Column:
    """The format by the leading bytes; by extension only for text without NUL. Null for what is no book and no archive."""
    path, content = C.col(path), C.col(content)
    head = F.substring(content, 1, HEAD)
    at = lambda first, n: F.hex(F.substring(head, first + 1, n))
    begins = lambda magic: at(0, len(magic)) == magic.hex().upper()
    name = F.lower(C.file_name(path))
    by_name = F.when(name.rlike(r".\.txt$"), "txt").when(name.rlike(r".\.(htm|html|xhtml)$"), "html")
    zipped = begins(b"PK")
    kind = _zip_kind(F.when(zipped, content))  # only archives reach Python with their bytes
    return (
        F.when(name.isin(*fixed.SKIPPED_FILES), F.lit(None))
        .when(at(60, 8).isin(b"BOOKMOBI".hex().upper(), b"TEXtREAd".hex().upper()), "mobi")
        .when(begins(b"%PDF"), "pdf")
        .when(begins(b"{\\rtf"), "rtf")
        .when(begins(bytes.fromhex("D0CF11E0A1B11AE1")), "doc")
        .when(begins(b"Rar!"), "rar")
        .when(begins(b"7z\xbc\xaf"), "7z")
        .when(zipped, kind)
        .when(~F.hex(head).rlike("^(..)*?00"), by_name)
    )


def plain_text(data: bytes, n: int = TEXT_CHARS) -> str:
    """The first of UTF-8, cp1250 and cp1251 that decodes the first 4 n bytes, else Latin-1."""
    raw = data[: 4 * n]
    for encoding in ("utf-8", "cp1250", "cp1251", "latin-1"):
        try:
            return raw.decode(encoding)[:n]
        except UnicodeDecodeError:
            pass
    return ""


def strip_html(page: str) -> str:
    bare = re.sub(r"<(script|style|head)[^>]*>.*?</\1>", " ", page, flags=re.I | re.S)
    return " ".join(re.sub(r"<[^>]+>", " ", bare).split())


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Documents in reading order; without a usable package file the pages by name."""
    names = z.namelist()
    package = next((x for x in names if x.endswith(".opf")), None)
    order: list[str] = []
    if package:
        folder = package[: package.rfind("/") + 1]
        text = z.read(package).decode("utf-8", "ignore")
        hrefs = {}
        for item in re.findall(r"<item\b[^>]*>", text):
            value = {k: v for k, v in re.findall(r'\b(id|href)="([^"]+)"', item)}
            if len(value) == 2:
                hrefs[value["id"]] = folder + value["href"]
        order = [hrefs[i] for i in re.findall(r'<itemref[^>]*\bidref="([^"]+)"', text) if i in hrefs]
    return [d for d in order if d in set(names)] or sorted(x for x in names if x.lower().endswith((".xhtml", ".html", ".htm")))


def epub_text(data: bytes, n: int = TEXT_CHARS) -> str:
    z = _open(data)
    if z is None:
        return ""
    text = ""
    try:
        for doc in _spine(z)[:SPINE_DOCS]:
            text += " " + strip_html(z.read(doc).decode("utf-8", "ignore"))
            if len(text) >= n:
                break
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, zlib.error):
        return ""
    return text[:n]


def epub_tags(data: bytes) -> tuple[str | None, str | None, str | None]:
    """title, authors (joined by &), tags of the package file."""
    z = _open(data)
    package = next((x for x in z.namelist() if x.endswith(".opf")), None) if z else None
    if not package:
        return None, None, None
    import html

    text = z.read(package).decode("utf-8", "ignore")
    found = lambda tag: [html.unescape(" ".join(x.split())) for x in re.findall(rf"<dc:{tag}\b[^>]*>(.*?)</dc:{tag}>", text, re.S)]
    title, authors, tags = found("title"), found("creator"), found("subject")
    return (title or [None])[0], " & ".join(authors) or None, ", ".join(tags) or None


def unpack_palmdoc(data: bytes) -> bytes:
    """PalmDOC: literals, runs of literals, pairs of distance and length, and a blank with a character."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c & 0x7F))
        else:
            if i == len(data):
                break
            distance, length = ((c & 0x3F) << 8 | data[i]) >> 3, (data[i] & 7) + 3
            i += 1
            if not 0 < distance <= len(out):
                break
            for _ in range(length):  # may overlap what it writes
                out.append(out[-distance])
    return bytes(out)


def trailing_bytes(record: bytes, flags: int) -> int:
    """Bytes after a record's text: for each flag an entry that tells its own size at its end, then multi-byte overlap."""
    size = 0
    for _ in range(bin(flags >> 1 & 0x7FFF).count("1")):
        value = 0
        for k, b in enumerate(reversed(record[max(0, len(record) - size - 4) : len(record) - size])):
            value |= (b & 0x7F) << 7 * k
            if b >= 0x80:
                break
        size += value
    return size + (record[len(record) - size - 1] & 3) + 1 if flags & 1 else size


def mobi_text(data: bytes, records: int = MOBI_RECORDS) -> str:
    """Markup of the first text records; empty if encrypted, damaged or of another compression."""
    try:
        (count,) = struct.unpack_from(">H", data, 76)
        starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(count)] + [len(data)]
        head = data[starts[0] : starts[1]]
        compression, n_text, encrypted = (struct.unpack_from(">H", head, at)[0] for at in (0, 8, 12))
        size, encoding = struct.unpack_from(">I", head, 20)[0], struct.unpack_from(">I", head, 28)[0]
        if head[16:20] != b"MOBI" or encrypted or compression not in (1, 2):
            return ""
        flags = struct.unpack_from(">H", head, 0xF2)[0] if size >= 0xE4 else 0
        out = b""
        for a, b in list(zip(starts, starts[1:]))[1 : 1 + min(n_text, records)]:
            record = data[a:b]
            record = record[: len(record) - trailing_bytes(record, flags)]
            out += unpack_palmdoc(record) if compression == 2 else record
    except (struct.error, IndexError):
        return ""
    return out.decode("utf-8" if encoding == 65001 else "cp1252", "ignore")


def _leading(fmt: str | None, data: bytes, n: int) -> tuple[str | None, str | None]:
    if fmt == "epub":
        return epub_text(data, n), None
    if fmt == "mobi":
        text = strip_html(mobi_text(data))
        return (text[:n], None) if len(text) > 200 else outside.text(fmt, data, n)
    if fmt == "txt":
        return plain_text(data, n), None
    if fmt == "html":
        return strip_html(plain_text(data, 4 * n))[:n], None
    if fmt == "docx":
        z = _open(data)
        try:
            return (" ".join(re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", " ", z.read("word/document.xml").decode("utf-8", "ignore"))).split())[:n], None) if z else (None, "damaged docx")
        except (KeyError, zipfile.BadZipFile, zlib.error):
            return None, "damaged docx"
    return outside.text(fmt, data, n)


_text_type = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
_tags_type = T.StructType([T.StructField(k, T.StringType()) for k in ("title", "authors", "tags")])


def leading_text(format: Column | str = "format", content: Column | str = "content", n: int = TEXT_CHARS) -> Column:
    """struct(text, error) of the first ``n`` characters; what fails is an error in its row, never of the job."""

    @F.pandas_udf(_text_type)
    def read(fmt: pd.Series, data: pd.Series) -> pd.DataFrame:
        def one(f, d):
            try:
                return _leading(f, bytes(d) if d is not None else b"", n)
            except Exception as e:  # one bad file must not end a scan
                return None, repr(e)[:200]

        return pd.DataFrame([one(f, d) for f, d in zip(fmt, data)], columns=["text", "error"])

    return read(C.col(format), C.col(content))


@F.pandas_udf(_tags_type)
def embedded_tags(fmt: pd.Series, data: pd.Series) -> pd.DataFrame:
    """struct(title, authors, tags) of epubs, and of other formats where the metadata program is installed."""
    def one(f, d):
        try:
            return (None, None, None) if d is None else epub_tags(bytes(d)) if f == "epub" else outside.tags(f, bytes(d))
        except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, zlib.error):
            return None, None, None

    return pd.DataFrame([one(f, d) for f, d in zip(fmt, data)], columns=["title", "authors", "tags"])


_member = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())]))


@F.pandas_udf(_member)
def archive_members(fmt: pd.Series, data: pd.Series) -> pd.Series:
    """Files of zip archives by path, and of others where an unpacker is installed; damaged ones have none."""
    def one(f, d):
        if f != "zip":
            return [{"path": k, "content": v} for k, v in outside.members(f, bytes(d or b""))]
        z = None if d is None else _open(bytes(d))
        found = []
        for name in sorted(x for x in (z.namelist() if z else []) if not x.endswith("/")):
            try:
                found.append({"path": name, "content": z.read(name)})
            except (zipfile.BadZipFile, RuntimeError, zlib.error, OSError):
                continue
        return found

    return pd.Series([one(f, d) for f, d in zip(fmt, data)], dtype=object)


def find_books(files: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(books, skipped): books by real format with the archives' books among them (``archive`` is set), in path order.

    ``limit`` counts books after unpacking. Archives without a book, or that need an outside tool, are skipped.
    """
    known = files.withColumn("format", detect())
    plain = known.where(F.col("format").isin(*fixed.BOOK_FORMATS)).select("path", F.lit(None).cast("string").alias("archive"), "format", "content")
    inner = known.where(F.col("format").isin(*fixed.ARCHIVE_FORMATS)).select(F.col("path").alias("archive"), F.explode(archive_members("format", "content")).alias("m"))
    inner = inner.select(F.concat_ws("!/", "archive", "m.path").alias("path"), "archive", F.col("m.content").alias("content"))
    inner = inner.withColumn("format", detect()).where(F.col("format").isin(*fixed.BOOK_FORMATS)).select("path", "archive", "format", "content")
    books = plain.unionByName(inner)
    full = inner.select(F.col("archive").alias("path")).distinct()
    skipped = known.where(F.col("format").isNull() | F.col("format").isin(*fixed.ARCHIVE_FORMATS)).join(full, "path", "left_anti").select("path", "format")
    return (books.orderBy("path").limit(limit) if limit else books), skipped


def extract(books: DataFrame, n: int = TEXT_CHARS) -> DataFrame:
    """path, archive, format, title, authors, tags, snippet, error of books with content."""
    made = books.withColumn("__t", leading_text(n=n)).withColumn("__g", embedded_tags("format", "content"))
    return made.select("path", "archive", "format", "__g.title", "__g.authors", "__g.tags", F.col("__t.text").alias("snippet"), "__t.error")


def listing(files: DataFrame, root: str) -> DataFrame:
    """path of placed books: epub and pdf files under ``root``, but not in top folders that begin with an underscore."""
    below = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    return files.where(F.lower("path").rlike(r"\.(epub|pdf)$") & F.col("path").startswith(root.rstrip("/") + "/") & ~below.startswith("_")).select("path")


#: Characters that a converted epub must hold among its first 2000.
LEAST_TEXT = 200


def problem_of(data: bytes | None) -> str | None:
    """What is wrong with a converted epub, or null: not a zip, a damaged member, or almost no text."""
    z = None if data is None else _open(data)
    if z is None:
        return "not a valid zip"
    try:
        if z.testzip() is not None:
            return "damaged"
    except (zipfile.BadZipFile, zlib.error, RuntimeError, OSError):
        return "damaged"
    return None if len(epub_text(data, 2000).strip()) >= LEAST_TEXT else "almost no text"


@F.pandas_udf(T.StringType())
def epub_problem(data: pd.Series) -> pd.Series:
    return data.map(lambda d: problem_of(None if d is None else bytes(d)))
