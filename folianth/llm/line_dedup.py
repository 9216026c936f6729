"""Line dedup, native: explode normalised lines, hash them, find hashes of several documents, drop, reassemble.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of enough
code points found in enough documents loses all its lines except those of the smallest row id
that holds it. Lines carry their positions: the lost positions of a text are taken from all of them, and the rest
is put together in order, in time that grows with the number of lines, so texts may be of any length.

A line that a large part of all documents holds is one key of the join that names lost lines. Both sides of
that join are read from tables, so that Spark may split the key's rows over tasks (``lost_lines``).

Null and empty texts are one empty line. Rows of a null id neither count nor lose
lines; rows that share an id are one document and lose the same lines; other columns pass through
(helper columns carry a ``__ld_`` prefix). Repeated rows stay repeated. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_KEY = 10
MIN_DOCUMENTS = 2


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone: the fast built-in where all bytes are ASCII, else one by one."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_keys(lines: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, first): keys of ``min_documents`` ids or more, and the smallest id of each."""
    if min_documents == 2:  # two distinct ids exist where the smallest isn't the largest; both combine on the map side
        found = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        found = lines.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("id").alias("n")).where(F.col("n") >= min_documents)
    return found.select("h1", "h2", "first")


def lost_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, th, pos) of the lines that go. Give it two tables: a key that many rows share is then split by adaptive execution."""
    return lines.join(repeated, ["h1", "h2"]).where(F.col("id") > F.col("first")).select("id", "th", "pos")


def dedup_lines(docs: DataFrame, text: str = "text", row_id: str = "doc_id", min_key: int = MIN_KEY, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All columns of ``docs`` plus ``__ld_lost``: the positions of the lines that go, from 0, or null where none does."""
    # The text stays below the explosion, which would copy it for each line.
    parted = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.xxhash64(text).alias("th"), split_lines(F.col(text)).alias("lines"))
    exploded = parted.select("id", "th", F.posexplode("lines").alias("pos", "line"))
    keyed = exploded.select("id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_key)
    # Two seeds make 128 bits: keys of any corpus stay apart.
    lines = staged(keyed.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")), "lines")
    lost = lost_lines(lines, staged(repeated_keys(lines, min_documents), "repeated-lines"))
    lost = staged(lost.groupBy(F.col("id").alias("__ld_id"), F.col("th").alias("__ld_th")).agg(F.collect_set("pos").alias("__ld_lost")), "lost-lines")
    return docs.join(lost, (docs[row_id] == F.col("__ld_id")) & (F.xxhash64(docs[text]) == F.col("__ld_th")), "left").drop("__ld_id", "__ld_th")


def n_lines(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def kept_text(text: Column, lost: Column) -> Column:
    """The text without the lines at the positions ``lost``."""
    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.when(lost.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(split_lines(text), rest))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    return dedup_lines(docs.select("doc_id", "text"), **options).select(
        "doc_id",
        n_lines(F.col("text")).alias("n_lines"),
        F.coalesce(F.size("__ld_lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("__ld_lost")).cast("binary"), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The documents with the kept lines as their text, and n_chars to match.

    ``drop_emptied``: a document that lost lines and has no other character than white space left goes. Documents
    that were empty before stay.
    """
    names = docs.columns
    out = dedup_lines(docs).withColumn("text", kept_text(F.col("text"), F.col("__ld_lost")))
    if drop_emptied:
        out = out.where(F.col("__ld_lost").isNull() | (F.trim("text", F.lit(BLANKS)) != ""))
    return (out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out).select(*names)


SQL = r"""
WITH lines AS (
    SELECT doc_id, r, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, r, unnest(l) AS line, generate_subscripts(l, 1) AS p
          FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), repeated AS (
    SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT l.*, coalesce(l.doc_id > d.first, false) AS lost FROM lines l LEFT JOIN repeated d ON l.k = d.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r
"""
