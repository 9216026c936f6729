"""Benchmark decontamination, native: winnowed fingerprints are joined, and exact text confirms what they find.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Every window of
``WINDOW`` words holds WINDOW - GRAM + 1 grams of ``GRAM`` words; winnowing keeps the smallest gram
hash of each window. Equal windows keep equal hashes, so a shared span of WINDOW words or more is
never missed. Neighbouring windows of a document that keep the same hash are one fingerprint, a row of its own with
the words that it spans, and fingerprints of documents and benchmark meet in a join. The benchmark's are broadcast up
to a number of them (``BROADCAST``), so that texts are read once and never dealt out; beyond it both sides are dealt out by
fingerprint. Runs that match are read as windows again and compared as text, and neighbouring windows extend a hit word by
word.

Windows that many items share are named once: a window carries the name of its set of items, a document the
sets of its windows, and only distinct combinations of sets are spelt out as items. So a passage of boilerplate in all items
and in many documents costs no row per document and item.

Items of fewer words, but not none, are one window each and are looked up by a hash of all their
words; they aren't winnowed, as winnowing promises nothing below its window. Texts may be of any length. Null
texts have no words. Items with a null id can hit words but are not counted or named.
Rows repeated in the documents are repeated in the result. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import ascii_lower, let
from .staging import staged

#: Between words; of A-Z and a-z alike, as it is applied before or after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
#: Fingerprints of the benchmark (8 bytes each, some 50 in memory) that are broadcast, at most.
BROADCAST = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(h: Column, n: int) -> Column:
    """A hash of every n consecutive word hashes."""
    return F.transform(_starts(h, n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))


def _none() -> Column:
    return F.array().cast("array<int>")


def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(_none())


def fingerprint(g: Column, i: Column, span: int) -> Column:
    """The hash that winnowing keeps of the window that begins at gram i."""
    return F.least(*(F.get(g, i + k) for k in range(span))) if span > 1 else F.get(g, i)


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """item_id, n (words), win (the words), kept (the fingerprint, or the hash of a short item) of each distinct window."""
    span = window - gram + 1
    base = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    full = F.transform(_starts(F.col("w"), window), lambda i: F.struct(F.lit(window).alias("n"), F.array_join(F.slice("w", i + 1, F.lit(window)), " ").alias("win"), let(grams(word_hashes(F.slice("w", i + 1, F.lit(window))), gram), lambda g: fingerprint(g, F.lit(0), span)).alias("kept")))
    # A short item's only gram has all its words.
    whole = F.coalesce(*(F.when(F.size("w") == n, grams(word_hashes(F.col("w")), n)[0]) for n in range(1, window)))
    short = F.array(F.struct(F.size("w").alias("n"), F.array_join("w", " ").alias("win"), whole.alias("kept")))
    return base.select("item_id", F.explode(F.when(F.size("w") >= window, full).otherwise(short)).alias("x")).select("item_id", "x.*").distinct()


def runs(w: Column, h: Column, n: int, window: int, gram: int) -> Column:
    """array<struct<n, kept, at, to, span>>: the windows of n words that begin at words ``at`` to ``to`` all keep the hash ``kept``; ``span`` is all their words."""
    span = lambda at, to: F.array_join(F.slice(w, at + 1, to - at + n), " ")
    entry = lambda kept, at, to: F.struct(F.lit(n).alias("n"), kept.alias("kept"), at.alias("at"), to.alias("to"), span(at, to).alias("span"))
    if n < window:
        return F.transform(grams(h, n), lambda x, i: entry(x, i, i))
    least = let(grams(h, gram), lambda g: F.transform(_starts(h, window), lambda i: fingerprint(g, i, window - gram + 1)))

    def parted(kept: Column) -> Column:
        first = F.filter(F.transform(kept, lambda x, i: F.when((i == 0) | (x != F.get(kept, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda f: F.transform(f, lambda at, k: let(F.coalesce(F.get(f, k + 1), F.size(kept)) - 1, lambda to: entry(F.get(kept, at), at, to))))

    return let(least, parted)


def item_sets(wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((win, item_set) of each distinct window, (item_set, item_id)): windows of the same items have the same set."""
    known = F.col("item_id").isNotNull()
    part = lambda seed: F.coalesce(F.bit_xor(F.when(known, F.xxhash64(F.lit(seed), "item_id"))), F.lit(0).cast("long"))
    named = staged(wins.groupBy("win").agg(F.concat_ws(".", F.count("item_id"), part(1), part(2)).alias("item_set")), "item-sets")
    one = named.groupBy("item_set").agg(F.min("win").alias("win"))
    return named, wins.where(known).join(one, "win").select("item_set", "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, th1, th2 of each row of ``docs``."""
    wins = staged(item_windows(items, window, gram), "item-windows")
    prints = staged(wins.select("kept").distinct(), "fingerprints").withColumn("met", F.lit(True))
    prints = F.broadcast(prints) if prints.count() <= broadcast else prints
    lengths = sorted(r[0] for r in wins.select("n").distinct().collect())  # 1 to window
    key = ["doc_id", "th1", "th2"]
    row = [F.col("doc_id"), F.xxhash64("text").alias("th1"), F.xxhash64(F.lit(1), F.col("text")).alias("th2")]
    # Each row also has an entry of no window, so that rows without a match stay; its hash spreads it.
    nothing = F.array(F.struct(F.lit(0).alias("n"), F.xxhash64("text").alias("kept"), F.lit(-1).alias("at"), F.lit(-1).alias("to"), F.lit(None).cast("string").alias("span")))
    found = lambda w: F.struct(F.size(w).alias("n_words"), let(word_hashes(w), lambda h: F.concat(nothing, *(runs(w, h, n, window, gram) for n in lengths))).alias("runs"))
    spread = docs.select(*row, let(words(F.col("text")), found).alias("d")).select(*key, "d.n_words", F.explode("d.runs").alias("r")).select(*key, "n_words", "r.*")
    met = spread.join(prints, "kept", "left").where(F.col("met") | (F.col("n") == 0))
    met = staged(met.select(*key, "n_words", "n", "at", "to", "span"), "met")
    of_row = met.where("n = 0").groupBy(*key).agg(F.first("n_words").alias("n_words"), F.count("*").alias("rows"))

    read = lambda w: F.transform(F.sequence(F.col("at"), F.col("to")), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(w, i - F.col("at") + 1, F.col("n")), " ").alias("win")))
    windows = met.where("n > 0").select(*key, "n", F.explode(let(F.split("span", " "), read)).alias("x")).select(*key, "n", "x.*")
    named, members = item_sets(wins)
    hits = windows.join(named, "win").groupBy(*key).agg(F.collect_set(F.struct("pos", "n")).alias("places"), F.array_sort(F.collect_set("item_set")).alias("sets"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["pos"], p["pos"] + p["n"] - 1)))))
    hits = staged(hits.select(*key, covered.cast("long").alias("n_hit"), "sets"), "hits")

    spelt = hits.select("sets").distinct().select("sets", F.explode("sets").alias("item_set")).join(members, "item_set").select("sets", "item_id").distinct()
    spelt = spelt.groupBy("sets").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    spelt = staged(spelt.select("sets", "n_items", F.sha2(F.col("ids").cast("binary"), 256).alias("items_sha256")), "combinations")
    hits = hits.join(spelt, "sets", "left").select(*(F.col(c).alias(f"__{c}") for c in key), "n_hit", "n_items", "items_sha256")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("th1") == F.col("__th1")) & (F.col("th2") == F.col("__th2"))
    out = of_row.join(hits, same, "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), "th1", "th2", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("__copy"),
    )
    return out.drop("__copy")


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), items.select("item_id", "text"), **options).drop("th1", "th2")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit word."""
    hit = contamination(docs.select("doc_id", "text"), items.select("item_id", "text"), **options).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("th1").alias("__t1"), F.col("th2").alias("__t2")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__t1")) & (F.xxhash64(F.lit(1), docs["text"]) == F.col("__t2"))
    return docs.join(hit, same, "left_anti")


SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS win
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
    SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
    SELECT r, i, dw.n, item_id FROM dw JOIN iw USING (win)
), words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
