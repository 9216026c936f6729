"""Line dedup and decontamination against plain versions, on awkward rows and on the driver's tables."""

import hashlib
import random
import textwrap
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folianth.llm import license_scan, line_dedup, winnow
from folianth.llm.staging import staged

from .common import HAVE, LONG, LOWER, SF, UPPER, documents, empty, rows, words

KEY = str.maketrans(UPPER, LOWER)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(KEY)


def plain_dedup(data):
    held = defaultdict(set)
    for r in data:
        if r[0] is not None:
            for x in (r[1] or "").split("\n"):
                held[key(x)].add(r[0])
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        lost = lambda x: r[0] is not None and len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != r[0]  # noqa: B023, E731
        kept = [x for x in lines if not lost(x)]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark):
    assert Counter(map(tuple, line_dedup.report(documents(spark)).collect())) == plain_dedup(rows())


def test_line_dedup_threshold_of_three_documents(spark):
    got = {r.doc_id: r.n_dropped for r in line_dedup.report(spark.createDataFrame([(1, LONG), (2, LONG), (3, "x")], "doc_id long, text string"), min_documents=3).collect()}
    assert got == {1: 0, 2: 0, 3: 0}


def test_line_dedup_empty_table_and_columns(spark):
    assert line_dedup.report(empty(spark)).count() == 0
    kept = line_dedup.deduplicated(documents(spark))
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(rows())


ITEMS = [
    (1, LONG), (2, "kappa lambda mu"), (3, "Hello, WORLD"), (4, ""), (5, None), (6, "not in any of the texts at all, none of its ten words"), (10, "omega"),
    (None, "one alpha beta gamma delta epsilon zeta eta theta iota"), (7, LONG), (8, "Ünïcödé"),
]


def plain_windows(data, items):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = []
    for r in data:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [winnow.BROADCAST, 0])
def test_decontamination(spark, broadcast):
    """With the benchmark's side broadcast, and with both sides dealt out."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(map(tuple, winnow.report(documents(spark), items, broadcast=broadcast).collect())) == plain_windows(rows(), ITEMS)


def test_boilerplate_of_all_items(spark):
    """A passage that all items and many documents hold gives no row per document and item."""
    shared = " ".join(f"w{i}" for i in range(14))
    items = [(i, f"{shared} item{i} " + " ".join(f"i{i}x{k}" for k in range(12))) for i in range(300)]
    docs = [(i, f"doc {i} {shared} end {i}") for i in range(200)] + [(1000, items[7][1]), (1001, "x " + items[9][1] + " " + items[8][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, winnow.report(df, spark.createDataFrame(items, "item_id long, text string")).collect())) == plain_windows(docs, items)


def test_runs_are_winnowed_windows(spark):
    """Runs cover every window once, and each window keeps the smallest hash of its grams."""
    texts = ["a b c d e f g h i j k l m n o p q r s t u v", LONG, "a a a a a a a a a a a a a", "one two", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    w = winnow.words(F.col("t"))
    h = winnow.word_hashes(w)
    got = df.select("t", winnow.runs(w, h, 10, 10, 5).alias("runs"), winnow.grams(h, 5).alias("g")).collect()
    for r in got:
        kept = [min(r.g[i : i + 6]) for i in range(len(words(r.t)) - 9)]
        assert [x.kept for x in r.runs for _ in range(x["at"], x["to"] + 1)] == kept
        assert [i for x in r.runs for i in range(x["at"], x["to"] + 1)] == list(range(len(kept)))
        assert all(a.kept != b.kept for a, b in zip(r.runs, r.runs[1:]))
        assert [x.span.split(" ") for x in r.runs] == [words(r.t)[x["at"] : x["to"] + 10] for x in r.runs]


def splits(df):
    """How many joins of the executed plan were split for skew."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skew(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_line_of_half_of_all_documents_is_split(spark, skew):
    data = [(i, f"a line that half of all documents hold\nand line {i} of its own" if i % 2 else f"only the line {i} here\nand also line {i} here") for i in range(20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    keyed = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.posexplode(line_dedup.split_lines(F.col("text"))).alias("pos", "line"))
    lines = staged(keyed.select("id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")), "lines")
    lost = line_dedup.lost_lines(lines, staged(line_dedup.repeated_keys(lines, 2), "repeated"))
    assert splits(lost) == 1 and lost.count() == 9_999
    assert sum(r.n_dropped for r in line_dedup.report(df).collect()) == 9_999


def test_a_text_of_many_lines_takes_no_square_of_them(spark):
    line = "line number %d of a text that has very many of them"
    text = "\n".join(line % i for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nan end of its own")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n_dropped for r in line_dedup.report(df).collect()}
    assert got == {1: 0, 2: 200_000} and time.time() - began < 60


def test_emptied_documents_go_and_empty_ones_stay(spark):
    data = [(1, "the first line of all\nthe second line"), (2, "The second line\n  the first line of all"), (3, "the second line\n \t"), (4, ""), (5, None), (6, "\n \n"), (7, "the second line\nx")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(df, drop_emptied=True).collect()} == {1: data[0][1], 4: "", 5: "", 6: "\n \n", 7: "x"}
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()}[2] == ""


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = winnow.report(documents(spark), none).collect()
    assert len(got) == len(rows()) and not any(r.contaminated for r in got)
    assert winnow.report(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_clean_keeps_the_clean(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = winnow.clean(documents(spark), items)
    assert kept.columns == documents(spark).columns
    want = Counter(r[0] for r in rows() if plain_windows([r], ITEMS).most_common(1)[0][0][2] == 0)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_licences(spark):
    texts = ["Released under the MIT License.", "text\nLicensed under the Apache License, Version 2.0!\nmore", "This work is licensed under the GNU General Public License version 3", "MIT", None, "", "a plain line about a license of sorts"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_matches, r.licenses) for r in license_scan.report(df).collect()}
    assert got == {0: (1, "MIT"), 1: (1, "Apache-2.0"), 2: (1, "GPL-3.0"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (0, "")}
    assert license_scan.report(documents(spark)).count() == len(rows())
    assert license_scan.report(empty(spark)).count() == 0


def test_licence_bounds_lose_nothing(spark):
    """Dice without size bounds gives the same matches."""
    lines = [t for _, t in license_scan.TEMPLATES] + ["this program is free software", "Licensed under CC", "Released under the MIT License. Or not at all, who knows"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = [(n, set(license_scan.template_bigrams(t))) for n, t in license_scan.TEMPLATES]
    got = {r.doc_id: r.matches for r in license_scan.scan(df).collect()}
    for i, line in enumerate(lines):
        b = set(license_scan.template_bigrams(line))
        best = max(((round(2 * len(b & s) / (len(b) + len(s)), 6), n) for n, s in sets), default=(0, ""))
        assert [(m.dice, m.license) for m in got[i]] == ([best] if best[0] >= 0.8 else [])


def test_hundreds_of_templates_and_texts_of_any_kind(spark):
    """Six hundred made licences are found, each where it stands, and nothing else; awkward texts give what they give without an index."""
    rng = random.Random(4)
    made = [(f"L{i}", " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(2, 120)))) for i in range(600)]
    templates = spark.createDataFrame([(n, t, i % 2 == 0) for i, (n, t) in enumerate(made)], "license string, text string, by_line boolean")
    texts = [textwrap.fill("Some words before. " + t + " And some after, of other kinds.", 60) for _, t in made[::20]] + ["w1 w2 w3", "", None, made[0][1] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.report(df, templates).collect()}
    long_enough = [i for i, (_, t) in enumerate(made[::20]) if len(t.split()) > 30]
    assert all(got[i] == made[20 * i][0] for i in long_enough) and len(long_enough) > 15
    assert got[31] == got[32] == "" and license_scan.report(documents(spark), templates).count() == len(rows())


def test_licences_wrapped_whole_and_within_lines(spark):
    known = license_scan.NOTICES
    whole = {n: max((t for m, t in known if m == n), key=len) for n, _ in known}
    wrap = lambda t, n=72, lead="": "\n".join(lead + x for x in textwrap.wrap(t, n))
    prose = "Some words of a text that has nothing to do with any of this. " * 20
    gpl2 = next(t for n, t in license_scan.TEMPLATES if n == "GPL-2.0")
    cases = [
        (license_scan._MIT, 1, "MIT"), (wrap(license_scan._MIT, 78), 1, "MIT"), (wrap(gpl2), 1, "GPL-2.0"),
        ("Copyright 2024 Foo. Licensed under the Apache License, Version 2.0. See the NOTICE file for details.", 1, "Apache-2.0"),
        ("This file is part of Foo, released under the MIT License.", 1, "MIT"),
        *((prose + "\n" + wrap(t, 70, "# ") + "\n" + prose, 1, n) for n, t in known),
        (whole["BSD-2-Clause"].replace(": 1.", ":\n1."), 1, "BSD-2-Clause"),
        (wrap(whole["MIT"]) + "\n" + prose + wrap(whole["MIT"]) + "\nReleased under the MIT License.\n" + wrap(license_scan._APACHE), 4, "Apache-2.0,MIT"),
        ("Licensed under the Apache License, Version 1.1, by the authors of it", 0, ""), ("It was released under the MIT Press imprint of the house", 0, ""), (prose, 0, ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.n_matches, r.licenses) for r in license_scan.report(df).collect()}
    assert [got[i] for i in range(len(cases))] == [(n, names) for _, n, names in cases]


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op2_license_scans", "op4_benchmark_decontamination", "op5_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from folianth.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())
