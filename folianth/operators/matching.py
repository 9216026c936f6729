"""Fuzzy joins of names: same-person pairs through lossless blocks, canonical spellings, overrides.

``same_person`` is neither symmetric nor transitive, so it is a Python function and the order of its
arguments matters. Pairs reach it through blocks that no true pair misses, as its branches are:

* equal sound and as many words: block by the sounds;
* initials: as many words, a surname of equal sound, and elsewhere equal words or initials of one sound: block by the
  sound of the surname and the first sounds of the rest;
* typos: as many words, each at least 0.75 alike and 0.85 on average, so one word of each is 0.85 alike. Words
  of x and y letters that are r alike share r (x + y) / 2 letters, whatever their order: each word gives the sets of
  so many of its letters, for each length that the other may have (``word_blocks``);
* the same three over the words without (middle) initials.

Pairs from typo blocks must also share enough letters of all words, which Spark tests before Python sees them.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianth.functions import columns as C
from folianth.functions.rowwise import rowwise
from folianth.functions.text import best_spelling, initial, name, same_person, skeleton, sound
from folianth.sources.staging import spread, staged

from .components import components


@rowwise(T.BooleanType())
def same_person_udf(a, b):
    return a is not None and b is not None and same_person(a, b)


#: Letters from rare to frequent, so that few words share the first of a word's.
_RARE = {c: i for i, c in enumerate("qxwyzfvhpgbcudjkmltsnroeia")}
#: How alike the closest words of two names are, at least, and any two words of them.
CLOSEST, CLOSE = 0.85, 0.75
#: Sets of letters that one word gives for one length of the other, at most; longer words give pairs of rare letters.
LETTER_SETS = 64


@lru_cache(1 << 12)
def _partner_lengths(n: int) -> tuple[tuple[int, int, bool], ...]:
    """(length of the other word, letters that both share, whether sets of so many letters are few) for a word of n letters."""
    out = []
    for m in range(1, 2 * n + 2):
        shared = math.ceil(CLOSEST * (n + m) / 2 - 1e-9)
        if shared <= min(n, m):
            out.append((m, shared, max(math.comb(n, shared), math.comb(m, shared)) <= LETTER_SETS))
    return tuple(out)


@lru_cache(1 << 12)
def word_blocks(word: str) -> frozenset[str]:
    """Blocks of which two words at least CLOSEST alike share one.

    They share ``shared`` letters, so a set of so many letters; or where these are many, any two of the rarest
    letters of either beyond those that need not be shared (of a prefix of n - shared + 2, both hold two of the common ones).
    """
    letters, n = sorted(word, key=_RARE.__getitem__), len(word)
    out = set()
    for m, shared, few in _partner_lengths(n):
        lengths = f"{min(n, m)} {max(n, m)}"
        if few:
            out.update(f"{lengths} {''.join(c)}" for c in combinations(letters, shared))
        else:
            out.update(f"{lengths} {''.join(c)}" for c in combinations(letters[: n - shared + 2], 2))
    return frozenset(out)


def name_blocks(raw: str) -> dict[str, tuple[int, ...]]:
    """Block by block the letters that a pair from it must share enough of (numbered, so that a repeated letter counts again); none for blocks of sounds."""
    n = name(raw)
    t = n.tokens
    ends = tuple(w for i, w in enumerate(t) if not initial(w) or i in (0, len(t) - 1))
    out: dict[str, tuple[int, ...]] = {}
    for form in {t, ends, n.full}:
        if not form:
            continue
        size = len(form)
        out[f"sound {size} {' '.join(sorted(map(skeleton, form)))}"] = ()
        out[f"initials {size} {skeleton(form[-1])} {' '.join(map(sound, form[:-1]))}"] = ()
        letters = tuple(sorted(64 * _RARE[c] + k for c, m in Counter("".join(form)).items() for k in range(min(m, 64))))
        for word in form:
            out.update((f"typos {size} {block}", letters) for block in word_blocks(word))
    return out


_block_type = T.ArrayType(T.StructType([T.StructField("block", T.StringType()), T.StructField("letters", T.ArrayType(T.IntegerType()))]))


@rowwise(_block_type)
def blocks_udf(raw):
    return [] if raw is None else [{"block": k, "letters": list(v)} for k, v in sorted(name_blocks(raw).items())]


def in_blocks(names: DataFrame, spelling: str, side: str) -> DataFrame:
    """All columns, a row for each block of ``spelling``: block, and ``side`` with its letters."""
    return names.withColumn("__b", F.explode(blocks_udf(spelling))).select(*names.columns, "__b.block", F.col("__b.letters").alias(side))


def may_match(left: str, right: str) -> Column:
    """Whether names met in a block of sounds, or share so many letters as names whose words are all CLOSE must."""
    return (F.size(left) == 0) | (F.size(F.array_intersect(left, right)) >= CLOSE / 2 * (F.size(left) + F.size(right)) - 1e-9)


def candidate_pairs(names: DataFrame, spelling: str = "name") -> DataFrame:
    """(a, b) of distinct spellings, a before b, that share a block."""
    distinct = spread(names.select(F.col(spelling).alias("n")).where(F.col("n").isNotNull()), "n").distinct()
    left, right = in_blocks(distinct.withColumnRenamed("n", "a"), "a", "la"), in_blocks(distinct.withColumnRenamed("n", "b"), "b", "lb")
    # Python compares the pairs that are left, a core each; the exchange by pair also makes them distinct.
    return spread(left.join(right, "block").where((F.col("a") < F.col("b")) & may_match("la", "lb")).select("a", "b"), "a", "b").distinct()


def directed_pairs(names: DataFrame, spelling: str = "name") -> DataFrame:
    """(a, b, ab, ba) of distinct spellings, a before b: whether same_person holds from a to b and from b to a, one at least."""
    both = candidate_pairs(names, spelling).select("a", "b", same_person_udf("a", "b").alias("ab"), same_person_udf("b", "a").alias("ba"))
    return both.where(F.col("ab") | F.col("ba"))


def same_person_pairs(names: DataFrame, spelling: str = "name") -> DataFrame:
    """(a, b) of distinct spellings, a before b, where same_person holds in either direction."""
    return directed_pairs(names, spelling).select("a", "b")


def spellings_by_key(names: DataFrame) -> DataFrame:
    """key, n (mentions), place (least), first (spelling at it), spellings (map of counts), from rows of (name, place)."""
    counted = names.select(C.key("name").alias("key"), "name", "place").groupBy("key", "name").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    return counted.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("place").alias("place"), F.min_by("name", "place").alias("first"),
        F.array_sort(F.collect_list(F.struct("place", "name", "n"))).alias("spellings"),
    )


def canonical_spellings(names: DataFrame) -> DataFrame:
    """(name, canonical) of every spelling in rows of (name, place); ``place`` orders the mentions.

    Spellings of one key are a group. Groups go by size, then place; each joins the first person one of
    whose spellings its own first spelling names. A group joins only along such a pair, so people
    never cross the connected components of pairs and each component is worked alone, in time that grows with its
    pairs: whom a spelling names is known from them.
    """
    groups = staged(spellings_by_key(names), "spellings")
    pairs = staged(directed_pairs(groups.select(F.explode("spellings.name").alias("name"))), "pairs")
    tied = components(pairs.select(C.key("a").alias("a"), C.key("b").alias("b")))
    named = pairs.where("ab").select(F.col("a").alias("first"), F.col("b").alias("other")).union(pairs.where("ba").select("b", "a"))
    named = named.groupBy("first").agg(F.collect_set("other").alias("named"))
    placed = groups.join(tied, groups["key"] == tied["node"], "left").withColumn("root", F.coalesce("root", "key")).join(named, "first", "left")

    def rank(row) -> tuple:
        place = row.place
        return -row.n, tuple(place.values()) if isinstance(place, dict) else tuple(place) if isinstance(place, tuple) else place

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        people: list[dict[str, int]] = []
        owner: dict[str, int] = {}
        for row in sorted(pdf.itertuples(), key=rank):
            homes = [owner[x] for x in (row.named if row.named is not None else ()) if x in owner]
            home = min(homes, default=len(people))
            if home == len(people):
                people.append({})
            for s in row.spellings:
                people[home][s["name"]] = people[home].get(s["name"], 0) + int(s["n"])
                owner[s["name"]] = home
        return pd.DataFrame([(s, best_spelling(p)) for p in people for s in p], columns=["name", "canonical"])

    return placed.groupBy("root").applyInPandas(merge, "name string, canonical string")


def order_prior(names: DataFrame) -> DataFrame:
    """fold, w: how often each order of words was seen, from rows of (source, name); imprint and llm count twice."""
    return names.groupBy(C.fold("name").alias("fold")).agg(F.sum(F.when(F.col("source").isin("impressum", "llm"), 2).otherwise(1)).alias("w"))


def fix_order(df: DataFrame, spelling: str, given: DataFrame, prior: DataFrame, out: str = "ordered") -> DataFrame:
    """Adds ``out``: two-word names with the given name first, by known given names or the order seen more often."""
    w = F.split(F.col(spelling), " ")
    two = (F.size(w) == 2) & ~F.exists(w, lambda x: x == "")
    t = df.withColumn("__back", F.when(two, F.concat_ws(" ", w[1], w[0]))).withColumn("__f", F.when(two, C.fold(w[0]))).withColumn("__r", F.when(two, C.fold(w[1])))
    for side, flag in (("__f", "__fk"), ("__r", "__rk")):
        t = t.join(given.select(F.col("given").alias(side), F.lit(True).alias(flag)).distinct(), side, "left")
    t = t.withColumn("__here", C.fold(spelling)).withColumn("__there", C.fold("__back"))
    for side, weight in (("__here", "__hw"), ("__there", "__tw")):
        t = t.join(prior.select(F.col("fold").alias(side), F.col("w").alias(weight)), side, "left")
    front, rear = F.coalesce("__fk", F.lit(False)), F.coalesce("__rk", F.lit(False))
    flip = F.when(front != rear, rear).otherwise(F.coalesce("__tw", F.lit(0)) > F.coalesce("__hw", F.lit(0)))
    return t.withColumn(out, F.when(F.col("__back").isNotNull() & flip, F.col("__back")).otherwise(F.col(spelling))).drop("__back", "__f", "__r", "__fk", "__rk", "__here", "__there", "__hw", "__tw")


def override_names(names: DataFrame, rules: DataFrame, spelling: str = "name") -> DataFrame:
    """(name, to): the first rule whose spelling each distinct name matches. Rules: rule_pos, from, to."""
    wanted = names.select(F.col(spelling).alias("name")).where(F.col("name").isNotNull()).distinct()
    left = in_blocks(wanted, "name", "ln")
    right = in_blocks(rules.select("rule_pos", F.col("from").alias("rule"), "to"), "rule", "lr")
    hits = left.join(right, "block").where(may_match("ln", "lr")).select("name", "rule_pos", "rule", "to").distinct().where(same_person_udf("name", "rule"))
    return hits.groupBy("name").agg(F.min_by("to", "rule_pos").alias("to"))


def override_files(df: DataFrame, path: Column, rules: list[tuple[str, str]], out: str = "forced") -> DataFrame:
    """Adds the target of the first rule whose fragment the path contains. The rules are a reviewed file, read on the driver."""
    found = F.lit(None).cast("string")
    for fragment, to in reversed(rules):
        found = F.when(F.contains(path, F.lit(fragment)), F.lit(to)).otherwise(found)
    return df.withColumn(out, found)
