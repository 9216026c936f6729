"""The verbs over a small library whose answers are known, and the operators that they are made of."""

import io
import os
import random
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folianth.functions import fixed, text, voting
from folianth.functions.evidence import gather
from folianth.operators import genres as G
from folianth.operators import matching as M
from folianth.operators import voting as V
from folianth.operators.components import components
from folianth.plans import actions, scan
from folianth.sources import files, tables

BOOKS = [
    # path, archive, format, title, authors, snippet, answer
    ("/lib/Ivo Andrić/Ivo Andrić - Prokleta avlija.epub", None, "epub", "Prokleta avlija", "Ivo Andric", "IVO ANDRIĆ Prokleta avlija", "Ivo Andrić"),
    ("/lib/Ivo Andrić/Na Drini ćuprija.epub", None, "epub", "Na Drini ćuprija", "Ivo Andrić", "Ivo Andrić", "Ivo Andrić"),
    ("/lib/Ivo Andrić/Andrić Ivo - Gospođica.pdf", None, "pdf", "Microsoft Word - x", "Unknown", "Ivo Andrić: Gospođica", "Ivo Andrić"),
    ("/lib/Razno/Alis Manro - Bekstvo.epub", None, "epub", "Bekstvo", "Alis Manro", "Naslov originala: Runaway / Alice Munro. Prevela", "Alice Munro"),
    ("/lib/Razno/Alice Munro - Runaway.mobi", None, "mobi", "Runaway", "Alice Munro", "© 2004 by Alice Munro", "Alice Munro"),
    ("/lib/Razno/stepski vuk.doc", None, "doc", None, None, "STEPSKI VUK Ovo je", None),
    ("/lib/x.zip!/Lem Stanislav - Solaris.txt", "/lib/Lem Stanislav - Solaris.zip", "txt", None, None, "Solaris", "Stanislav Lem"),
    ("/lib/Simak Kliford - Grad.epub", None, "epub", "Grad", "Simak Kliford", "", "Clifford Simak"),
    ("/lib/empty.txt", None, "txt", None, None, None, None),
]
SCHEMA = "path string, archive string, format string, title string, authors string, snippet string"
RULES = "from,to\nSimak Kliford,Clifford Simak\n# a remark,x\n\nfile:Solaris.zip,Stanislaw Lem\n"


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "overrides.csv"
    path.write_text(RULES, encoding="utf-8")
    rules = tables.read_overrides(spark, str(path))
    assert [tuple(r) for r in rules.orderBy("rule_pos").select("from", "to", "kind").collect()] == [("Simak Kliford", "Clifford Simak", "name"), ("Solaris.zip", "Stanislaw Lem", "file")]
    books = spark.createDataFrame([b[:6] for b in BOOKS], SCHEMA)
    return {r.path: r for r in scan.scan(books, overrides=rules).collect()}


def test_scan_finds_the_authors(report):
    assert len(report) == len(BOOKS)
    for path, *_, answer in BOOKS:
        if answer and "Solaris" not in path:
            assert report[path].author == answer, path
    assert report["/lib/empty.txt"].author is None and report["/lib/empty.txt"].status == "review"


def test_scan_details(report):
    lem = report["/lib/x.zip!/Lem Stanislav - Solaris.txt"]
    assert (lem.author, lem.confidence, lem.sources, lem.title) == ("Stanislaw Lem", 1.0, ["override"], "Solaris")
    caps = report["/lib/Razno/stepski vuk.doc"]
    assert caps.confidence <= 0.3 and caps.status == "review"
    assert report["/lib/Ivo Andrić/Ivo Andrić - Prokleta avlija.epub"].title == "Prokleta avlija"


def test_vote_is_the_sum_of_distinct_sources():
    d = voting.decide([("tags", "Ivo Andric"), ("filename", "Ivo Andrić"), ("filename", "Prokleta avlija")], None, {}, "", set(), [])
    assert d["author"] == "Ivo Andrić" and d["candidates"] == [("Ivo Andrić", 5), ("Prokleta avlija", 1)]
    assert d["confidence"] == round(5 / 40 + 4 / 10, 2)
    assert voting.decide([], None, {}, "", set(), [])["author"] is None


def test_coauthor_named_first_leads():
    groups = [["Ana Prva", "Ivo Drugi"]]
    d = voting.decide([("tags", "Ivo Drugi"), ("tags", "Ana Prva"), ("filename", "Ana Prva"), ("filename", "Ivo Drugi")], None, {}, "", set(), groups)
    assert d["author"] == "Ana Prva" and d["coauthors"] == ["Ivo Drugi"]


def test_swapped_tags_need_proof():
    found = gather("/x/A. J. Molloy - Ana Lee.epub", None, "epub", "A. J. Molloy", "Unknown", "")
    assert ("swappedtags", "A. J. Molloy") in found["candidates"]


def test_answers_are_asked_where_sources_disagree(spark):
    books = spark.createDataFrame([("/l/Xaver Quill - Petra Vonk.epub", None, "epub", None, None, "")], SCHEMA)
    said = spark.createDataFrame([("/l/Xaver Quill - Petra Vonk.epub", "Petra Vonk")], "path string, answer string")
    assert scan.scan(books, answers=said).first().author == "Petra Vonk"
    assert scan.scan(books, picks=said).first().author == "Petra Vonk"
    other = said.withColumn("answer", F.lit("Somebody Else"))
    assert scan.scan(books, picks=other).first().author != "Somebody Else"  # a pick can't bring in a name


def test_anthologies(spark):
    books = spark.createDataFrame([("/l/Antologija price.epub", None, "epub", None, "Ana Lee", ""), ("/l/b.epub", None, "epub", None, "Ana Lee", "SADRŽAJ: Walter M. Miller: ŽRTVOVANI 3 Dmitrij Bilenkin: X 9 Ana Lee: Y")], SCHEMA)
    assert {r.author for r in scan.scan(books, anthologies=True).collect()} == {fixed.ANTHOLOGY_AUTHOR}


SPELLINGS = ["Alice Munro", "Alis Manro", "Munro Alice", "Stephen King", "Stiven King", "Stephen Hawking", "Brandon Sanderson", "Brandon Sandreson", "Arthur C. Clarke", "Artur Klark", "Arthur Clarke", "George R. R. Martin", "Dž. R. R. Martin", "George Martin", "J. K. Rowling", "Joanne Kathleen Rowling", "Marić Ana", "Mrak Ana", "John A. Smith", "John B. Smith", "Nušić Branislav", "Branislav Nusic"]


def test_blocks_lose_no_pair(spark):
    df = spark.createDataFrame([(s,) for s in SPELLINGS], "name string")
    got = {(r.a, r.b) for r in M.same_person_pairs(df).collect()}
    want = {(a, b) for a in SPELLINGS for b in SPELLINGS if a < b and (text.same_person(a, b) or text.same_person(b, a))}
    assert got == want


SYLLABLES = ["a", "e", "i", "o", "u", "an", "er", "is", "on"]


def made_names(n, seed):
    """Random names, misspelt ones, and ones with initials."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) + rng.choice("bcdfgklmnprstvzhj") for _ in range(rng.randrange(1, 4))).capitalize()
    out = set()
    while len(out) < n:
        base = " ".join(word() for _ in range(rng.choice([2, 2, 2, 3])))
        out.add(base)
        letters = list(base)
        for _ in range(rng.randrange(1, 3)):
            k, kind = rng.randrange(1, len(letters)), rng.randrange(4)
            if kind == 0:
                letters[k] = rng.choice("abcdefghijklmnoprstuvz")
            elif kind == 1:
                letters.insert(k, rng.choice("aeioulnrst"))
            elif kind == 2 and len(letters) > 4:
                del letters[k]
            else:
                letters[k], letters[k - 1] = letters[k - 1], letters[k]
        out.add("".join(letters))
        first, *_, last = base.split()
        out |= {f"{first[0]}. {last}", f"{first} {rng.choice('ABC')}. {last}"} if rng.random() < 0.2 else set()
    return sorted(out)[:n]


def test_blocks_lose_no_pair_of_thousands():
    """Every true pair of random and misspelt names shares a block and enough letters."""
    names = made_names(1500, 5)
    blocks = [M.name_blocks(n) for n in names]
    found = 0
    for i, a in enumerate(names):
        for j in range(i):
            if text.same_person(a, names[j]) or text.same_person(names[j], a):
                found += 1
                shared = blocks[i].keys() & blocks[j].keys()
                pairs = [(blocks[i][k], blocks[j][k]) for k in shared]
                assert any(not x or len(set(x) & set(y)) >= 0.375 * (len(x) + len(y)) - 1e-9 for x, y in pairs), (a, names[j])
    assert found > 500


def test_blocks_join_few_pairs():
    """Of 16,000 names the blocks join less than a twentieth of all pairs, each pair counted for each block that it shares."""
    names = made_names(16_000, 6)
    size = Counter(k for n in names for k in M.name_blocks(n))
    assert sum(n * (n - 1) // 2 for n in size.values()) < len(names) ** 2 / 2 / 20


def test_pairs_of_made_names(spark):
    names = made_names(400, 7)
    got = {(r.a, r.b) for r in M.same_person_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and (text.same_person(a, b) or text.same_person(b, a))}


def test_canonical_spellings_equal_one_greedy_pass(spark):
    mentions = [s for i, s in enumerate(SPELLINGS) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(list(enumerate(mentions)), "place int, name string")
    got = {r["name"]: r.canonical for r in M.canonical_spellings(df).collect()}
    groups: dict = {}
    for s in mentions:
        groups.setdefault(text.key(s), []).append(s)
    people: list = []
    for k in sorted(groups, key=lambda k: -len(groups[k])):
        home = next((p for p in people if any(text.same_person(groups[k][0], x) for x in p)), None)
        if home is None:
            people.append(home := [])
        home += groups[k]
    assert got == {s: text.best_spelling(Counter(p)) for p in people for s in p}


def test_name_overrides_take_the_first_rule(spark):
    names = spark.createDataFrame([("Simak Kliford",), ("Ana Lee",), (None,)], "name string")
    rules = spark.createDataFrame([(2, "Kliford Simak", "late"), (1, "Simak Kliford", "Clifford Simak")], "rule_pos int, `from` string, `to` string")
    assert [tuple(r) for r in M.override_names(names, rules).collect()] == [("Simak Kliford", "Clifford Simak")]


def test_fix_order(spark):
    names = spark.createDataFrame([("Lem Stanislav",), ("Xa Yb",), ("Yb Xa",), ("Solo",), (None,)], "name string")
    given = spark.createDataFrame([("stanislav",)], "given string")
    prior = spark.createDataFrame([("yb xa", 3), ("xa yb", 1)], "fold string, w long")
    got = {r["name"]: r.ordered for r in M.fix_order(names, "name", given, prior).collect()}
    assert got == {"Lem Stanislav": "Stanislav Lem", "Xa Yb": "Yb Xa", "Yb Xa": "Yb Xa", "Solo": "Solo", None: None}


def test_genres(spark):
    answers = spark.createDataFrame([("b", 0, "sci-fi"), ("b", 1, "Literary Fiction"), ("b", 2, "naučna fantastika"), ("c", 0, "roman"), ("d", 0, "Historical Fictoin"), ("d", 1, "no such")], "book string, pos int, answer string")
    got = {r.book: r.genres for r in G.choose(answers).collect()}
    assert got == {"b": ["Science Fiction"], "c": ["Literary Fiction"], "d": ["Historical Fiction"]}


def test_harmonize(spark):
    log = spark.createDataFrame(
        [
            ("/o/A B/A B - X.epub", ["Romance"], 1), ("/o/A B/A B - X.pdf", ["Fantasy"], 2), ("/o/A B/A B - Hotel Boons-1.One.epub", ["War"], 3),
            ("/o/A B/A B - Hotel Boons-2.Two.epub", ["War", "History"], 4), ("/o/C/C - Solo.epub", ["Poetry"], 5), ("/o/C/C - Gone.epub", ["Poetry"], 6), ("/o/C/C - Solo.epub", ["Travel"], 7),
        ],
        "book string, genres array<string>, seq long",
    )
    there = log.where("book not like '%Gone%'").select(F.col("book").alias("path")).distinct()
    got = {r.book: r.genres for r in scan.harmonize(log, there).collect()}
    assert got == {
        "/o/A B/A B - X.epub": ["Fantasy", "Romance"], "/o/A B/A B - X.pdf": ["Fantasy", "Romance"],
        "/o/A B/A B - Hotel Boons-1.One.epub": ["War", "History"],
    }


def test_placement(spark):
    rep = spark.createDataFrame(
        [("/l/a.epub", None, "A B", ["C D"], "T", 0.9, "ok", "epub"), ("/l/b.mobi", None, "A B", None, "T", 0.9, "ok", "mobi"), ("/l/c.pdf", None, "A B", None, "T", 0.9, "ok", "pdf"), ("/l/d.xyz", "/l/d.zip", "A B", None, "U", 0.9, "ok", None), ("/l/e.epub", None, "A B", None, "V", 0.2, "review", "epub"), ("/l/f.epub", None, "A B", None, "", 0.5, "ok", "epub")],
        "path string, archive string, author string, coauthors array<string>, title string, confidence double, status string, format string",
    )
    there = spark.createDataFrame([("/o/A B/A B - T.pdf",)], "path string")
    got = {r.path: (r.dest, r.status, r.action) for r in scan.apply(rep, None, there, "/o").collect()}
    assert got == {
        "/l/a.epub": ("/o/A B/A B - T.epub", "done", "copy"),
        "/l/b.mobi": ("/o/_Duplicates/A B/A B - T.epub", "duplicate", "convert"),
        "/l/c.pdf": ("/o/_Duplicates/A B/A B - T.pdf", "duplicate", "copy"),
        "/l/d.xyz": (None, "failed", "none"),
        "/l/f.epub": ("/o/A B/f.epub", "done", "copy"),
    }
    log = spark.createDataFrame([("/l/a.epub", "/o/A B/A B - T.epub")], "src string, dest string")
    again = scan.apply(rep, log, spark.createDataFrame([("/o/A B/A B - T.epub",)], "path string"), "/o")
    assert "/l/a.epub" not in {r.path for r in again.collect()}


def test_parking_waits_for_all_members(spark):
    rep = spark.createDataFrame([("/l/z!/a", "/l/s/z.zip"), ("/l/z!/b", "/l/s/z.zip"), ("/l/c.epub", None), ("/elsewhere/d.epub", None)], "path string, archive string")
    placed = spark.createDataFrame([("/l/z!/a",), ("/l/c.epub",), ("/elsewhere/d.epub",)], "path string")
    got = {r.original: r.parked for r in scan.parkable(rep, placed, "/l", "/o").collect()}
    assert got == {"/l/c.epub": "/o/_Originals/c.epub", "/elsewhere/d.epub": "/o/_Originals/d.epub"}


def test_undo_runs_backwards(spark):
    log = spark.createDataFrame(
        [(1, "/l/a", "/o/a", None, None, None), (2, "/l/a", None, "/o/_Originals/a", None, None), (3, None, "/o/B/a", None, True, "/o/a")],
        "seq long, original string, dest string, parked string, merge boolean, `from` string",
    )
    got = [(r.step, r.src, r.to) for r in scan.undo(log).collect()]
    assert got == [("move", "/o/B/a", "/o/a"), ("restore", "/o/_Originals/a", "/l/a"), ("remove", "/o/a", None)]


def test_merges_of_merges_are_followed(spark):
    log = spark.createDataFrame(
        [(1, "/l/a", "/A", None, None, None), (2, "/l/a", None, "/park/a", None, None), (3, None, "/B", None, True, "/A"), (4, None, "/C", None, True, "/B")],
        "seq long, original string, dest string, parked string, merge boolean, `from` string",
    )
    got = actions.unplace(log, spark.createDataFrame([("/C",)], "dest string")).collect()
    assert [tuple(r) for r in got] == [("/C", "/l/a", "/park/a")]


def test_merge_and_rename_and_prune(spark):
    listed = spark.createDataFrame([("/o/Old/Old - X.epub",), ("/o/New/New - X.epub",), ("/o/Old/Old - Y.pdf",), ("/o/New/.DS_Store",)], "path string")
    got = {r["from"]: r.dest for r in actions.merge_authors(listed, "New", ["Old"], "/o").collect()}
    assert got == {"/o/Old/Old - X.epub": "/o/_Duplicates/New/New - X.epub", "/o/Old/Old - Y.pdf": "/o/New/New - Y.pdf"}
    placed = spark.createDataFrame([("/o/Nora Roberts/Nora Roberts - Nora Roberts-Hotel BoonsBoro.epub",), ("/o/Ana Lee/Ana Lee - Fine.epub",)], "path string")
    assert [r.to for r in scan.rename(placed).collect()] == ["/o/Nora Roberts/Nora Roberts - Hotel BoonsBoro.epub"]
    dirs = spark.createDataFrame([("/o",), ("/o/New",), ("/o/Old",), ("/o/Old/deep",)], "path string")
    files_ = spark.createDataFrame([("/o/New/.DS_Store",), ("/o/Old/deep/x.epub",)], "path string")
    assert [r.path for r in actions.empty_folders(dirs, files_).collect()] == ["/o/New"]


def epub(title="Runaway", author="Alice Munro", body="<p>Hello &amp; text</p>" * 40) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OPS/b.opf", f'<package><metadata><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator><dc:subject>SF</dc:subject></metadata><manifest><item id="b" href="2.xhtml"/><item href="1.xhtml" id="a"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/1.xhtml", "<html><head><title>no</title></head><body>First</body></html>")
        z.writestr("OPS/2.xhtml", f"<html><body>{body}</body></html>")
    return out.getvalue()


def mobi(text_: bytes, compression=1) -> bytes:
    head = bytearray(256)
    struct.pack_into(">HHIH", head, 0, compression, 0, len(text_), 1)
    head[16:20] = b"MOBI"
    struct.pack_into(">I", head, 20, 232)
    struct.pack_into(">I", head, 28, 65001)
    first = 78 + 16
    table = struct.pack(">I4x", first) + struct.pack(">I4x", first + len(head))
    name = bytearray(78)
    name[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", name, 76, 2)
    return bytes(name) + table + bytes(head) + text_


def test_readers(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("in/book.txt", "text of a book")
        z.writestr("in/picture.jpg", b"\xff\xd8\xff\0")
    made = {
        "a.dat": epub(), "b.mobi": mobi(b"<html><p>Palm text of a book. " * 20), "c.txt": "čaj и чай".encode(), "d.txt": "žaba".encode("cp1250"), "e.txt": b"a\0b",
        "f.pdf": b"%PDF-1.4", "g.zip": inner.getvalue(), "h.rtf": b"{\\rtf1}", "i.zip": b"PKbroken", "j.rar": b"Rar!x", "metadata.opf": b"<x/>", "k.html": b"<p>page</p>",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    found, skipped = files.find_books(files.read_files(spark, str(tmp_path)))
    assert {os.path.basename(r.path): r.format for r in found.collect()} == {"a.dat": "epub", "b.mobi": "mobi", "c.txt": "txt", "d.txt": "txt", "f.pdf": "pdf", "book.txt": "txt", "h.rtf": "rtf", "k.html": "html"}
    assert {os.path.basename(r.path) for r in skipped.collect()} == {"e.txt", "i.zip", "j.rar", "metadata.opf"}
    got = {os.path.basename(r.path): r for r in files.extract(found).collect()}
    assert got["a.dat"].snippet.startswith(" First Hello &amp; text") and (got["a.dat"].title, got["a.dat"].authors, got["a.dat"].tags) == ("Runaway", "Alice Munro", "SF")
    assert got["b.mobi"].snippet.startswith("Palm text of a book.") and got["d.txt"].snippet == "žaba" and got["c.txt"].snippet == "čaj и чай"
    assert got["f.pdf"].snippet is None and "outside" in got["f.pdf"].error
    assert got["book.txt"].archive.endswith("g.zip")
    assert files.find_books(files.read_files(spark, str(tmp_path)), limit=2)[0].count() == 2


def test_palmdoc():
    assert files.unpack_palmdoc(b"\x03abc" + bytes((0x80 | (3 << 3 >> 8), 3 << 3 & 0xFF | 3)) + b"\xc1") == b"abcabcabc A"
    assert files.unpack_palmdoc(b"x\x80") == b"x"
    assert files.mobi_text(b"") == "" and files.mobi_text(mobi(b"x", 17480)) == ""
    assert files.trailing_bytes(b"textxx\x83", 0b10) == 3 and files.trailing_bytes(b"text\x01", 1) == 2


def test_report_round_trip(spark, tmp_path):
    books = spark.createDataFrame([('/l/Ana Lee - A "b", c.epub', None, "epub", 'A "b", c', "Ana Lee", "line\nbreak")], SCHEMA)
    rep = scan.scan(books)
    tables.write_report(rep, str(tmp_path / "r"))
    back = tables.read_report(spark, str(tmp_path / "r")).collect()
    assert len(back) == 1 and back[0].author == "Ana Lee" and back[0].path == '/l/Ana Lee - A "b", c.epub' and tuple(back[0].asDict()) == fixed.REPORT_FIELDS


def test_logs_and_cache(spark, tmp_path):
    entries = spark.createDataFrame([("/l/a", "/o/a"), ("/l/b", "/o/b")], "src string, dest string")
    tables.append_log(entries, str(tmp_path / "log"), 1, ["src"])
    tables.append_log(entries.limit(1), str(tmp_path / "log"), 2, ["src"])
    log = tables.read_log(spark, str(tmp_path / "log"), tables.MOVES)
    assert log.count() == 3 and log.select("seq").distinct().count() == 3
    there = spark.createDataFrame([("/o/b",)], "path string")
    assert [r.path for r in tables.placed_sources(log, there).collect()] == ["/l/b"]
    tables.remember(spark.createDataFrame([("k", "tags", "v")], "file_key string, field string, value string"), str(tmp_path / "cache"))
    got = tables.cached(spark.createDataFrame([("k",), ("m",)], "file_key string"), spark.read.parquet(str(tmp_path / "cache")), "tags")
    assert {r.file_key: r.tags for r in got.collect()} == {"k": "v", "m": None}
    # What is remembered later counts, and a key stays one row.
    tables.remember(spark.createDataFrame([("k", "tags", "a later one"), ("m", "tags", "w")], "file_key string, field string, value string"), str(tmp_path / "cache"), 1)
    got = tables.cached(spark.createDataFrame([("k",), ("m",)], "file_key string"), spark.read.parquet(str(tmp_path / "cache")), "tags")
    assert sorted(tuple(r) for r in got.collect()) == [("k", "a later one"), ("m", "w")]


def test_log_order_goes_on_over_partitions(spark, tmp_path):
    entries = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n")).repartition(7)
    tables.append_log(entries, str(tmp_path / "log"), 3, ["n"])
    tables.append_log(entries.limit(10), str(tmp_path / "log"), tables.next_batch(tables.read_log(spark, str(tmp_path / "log"), "n long, seq long")), ["n"])
    got = tables.read_log(spark, str(tmp_path / "log"), "n long, seq long").orderBy("seq").collect()
    assert [r.n for r in got[:5000]] == list(range(5000)) and [r.seq for r in got[:5000]] == [(3 << 40) + 1 + i for i in range(5000)]
    assert {r.seq >> 40 for r in got[5000:]} == {4}
    kept = tables.retire_log(spark, str(tmp_path / "log"))
    assert kept.endswith(".undone.log") and tables.read_log_if_any(spark, str(tmp_path / "log"), "n long") is None


def fake_program(folder, name, script):
    path = folder / name
    path.write_text(f"#!/bin/sh\n{script}\n")
    path.chmod(0o755)


def test_outside_programs(tmp_path, monkeypatch):
    from folianth.sources import outside

    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    monkeypatch.setattr(outside.shutil, "which", lambda name: str(tmp_path / name) if (tmp_path / name).exists() else None)
    assert outside.text("pdf", b"%PDF", 9) == (None, "pdf needs an outside reader") and outside.tags("pdf", b"") == (None, None, None) and outside.members("rar", b"") == []
    fake_program(tmp_path, "pdftotext", 'echo "text of $3" | sed "s:/.*/::"')
    fake_program(tmp_path, "ebook-convert", 'head -c 20 "$1" > "$2"')
    fake_program(tmp_path, "ebook-meta", 'echo "Title : Grad"; echo "Author(s) : Ana Lee [Lee, Ana]"; echo "Tags : SF, War"')
    fake_program(tmp_path, "unar", 'mkdir "$5/in"; echo b > "$5/in/b.txt"; echo a > "$5/a.txt"')
    assert outside.text("pdf", b"%PDF", 16) == ("text of book.pdf", None)
    assert outside.text("rtf", b"{\\rtf words", 9) == ("{\\rtf wor", None)
    assert outside.tags("mobi", b"x") == ("Grad", "Ana Lee", "SF, War") and outside.tags("txt", b"x") == (None, None, None)
    assert outside.members("7z", b"x") == [("a.txt", b"a\n"), ("in/b.txt", b"b\n")] and outside.members("zip", b"x") == []
    fake_program(tmp_path, "pdftotext", "echo no >&2; exit 3")
    assert outside.text("pdf", b"%PDF", 9) == (None, "pdftotext failed: no")


def test_converting_mends_endings_and_checks_the_book(tmp_path, monkeypatch):
    from folianth.plans import executors
    from folianth.sources import outside

    monkeypatch.setattr(outside.shutil, "which", lambda name: str(tmp_path / name) if (tmp_path / name).exists() else None)
    (tmp_path / "book. mobi").write_bytes(b"x")
    (tmp_path / "made").write_bytes(epub())
    src, dest = str(tmp_path / "book. mobi"), str(tmp_path / "out" / "a.epub")
    assert executors.convert(src, dest, "mobi") == "ebook-convert is not installed"
    fake_program(tmp_path, "ebook-convert", f'case "$1" in *.mobi|*.docx) cp "{tmp_path}/made" "$2";; *) exit 1;; esac')
    assert executors.convert(src, dest, "mobi") is None and os.path.exists(dest)
    (tmp_path / "b.doc").write_bytes(b"x")
    assert executors.convert(str(tmp_path / "b.doc"), dest, "doc") == "textutil is not installed"
    fake_program(tmp_path, "textutil", 'cp "$5" "$4"')
    assert executors.convert(str(tmp_path / "b.doc"), str(tmp_path / "out" / "b.epub"), "doc") is None
    (tmp_path / "made").write_bytes(epub(body=""))
    assert "almost no text" in executors.convert(src, dest, "mobi")
    assert executors.tag_genres(dest, ["SF"]) == "ebook-meta is not installed"


def test_genres_are_written(spark):
    from folianth.plans import executors

    plan = spark.createDataFrame([("/o/a.epub", ["SF"], "x"), ("/o/b.epub", [], "")], "book string, genres array<string>, old_tags string")
    got = {r.book: (r.old_tags, r.error) for r in executors.write_genres(plan, write=lambda book, genres: f"{book} {genres}").collect()}
    assert got == {"/o/a.epub": ("x", "/o/a.epub ['SF']"), "/o/b.epub": ("", "no genre")}


def test_undoing_restores_and_removes(spark, tmp_path):
    from folianth.plans import executors

    at = lambda *x: str(tmp_path.joinpath(*x))
    for x in (("out", "New", "New - A.epub"), ("out", "_Originals", "a.epub"), ("out", "C", "c.epub")):
        os.makedirs(os.path.dirname(at(*x)), exist_ok=True)
        tmp_path.joinpath(*x).write_bytes(b"x")
    none = None
    log = spark.createDataFrame([
        (1, none, at("in", "a.epub"), at("out", "Old", "Old - A.epub"), none, none), (2, none, at("in", "a.epub"), none, at("out", "_Originals", "a.epub"), none),
        (3, True, none, at("out", "New", "New - A.epub"), none, at("out", "Old", "Old - A.epub")), (4, none, at("in", "c.epub"), at("out", "C", "c.epub"), none, none),
        (5, none, at("in", "d.epub"), at("out", "D", "d.epub"), none, none),
    ], "seq long, merge boolean, original string, dest string, parked string, `from` string")
    done = executors.undo(actions.undo(log), tag=lambda *a: None).collect()
    assert {r.src: r.error for r in done}[at("out", "D", "d.epub")] == "it is gone" and sum(r.error is None for r in done) == 4
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs) == ["in/a.epub"]


def test_stream_extracts_new_files_once(spark, tmp_path):
    from folianth.streaming.incremental import extract_new

    (tmp_path / "in").mkdir()
    run = lambda: extract_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    (tmp_path / "in" / "Ana Lee - One.epub").write_bytes(epub())
    run()
    (tmp_path / "in" / "Ana Lee - Two.txt").write_bytes(b"some text")
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(os.path.basename(r.path) for r in got.select("path").collect()) == ["Ana%20Lee%20-%20One.epub", "Ana%20Lee%20-%20Two.txt"] or got.count() == 2
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("in/book.txt", "text of a book")
    (tmp_path / "in" / "c.zip").write_bytes(inner.getvalue())
    (tmp_path / "in" / "d.rar").write_bytes(b"Rar!x")
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.where("archive is not null").count() == 1
    assert [os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out_skipped")).collect()] == ["d.rar"]


def test_stream_counts_names_in_event_time(spark, tmp_path):
    from folianth.streaming.incremental import name_counts

    rows = [("2024-01-01 00:10:00", "Ana Lee"), ("2024-01-01 00:20:00", "Lee Ana"), ("2024-01-01 01:10:00", "Ana Lee"), ("2024-01-01 00:30:00", "Ivo Andrić")]
    spark.createDataFrame(rows, "t string, name string").select(F.to_timestamp("t").alias("ts"), "name").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, name string").parquet(str(tmp_path / "in"))
    query = name_counts(stream).writeStream.format("memory").queryName("name_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.key, r.window.start.hour, r.n) for r in spark.table("name_counts").collect())
    assert got == [("ana lee", 0, 2), ("ana lee", 1, 1), ("andric ivo", 0, 1)]


def test_accuracy_and_folder_vote(spark):
    df = spark.createDataFrame([("d", True, True), ("d", True, False), ("e", True, False), ("e", True, False), ("e", True, True)], "g string, has boolean, yes boolean")
    got = {r.g: r.keep for r in V.folder_vote(df, "g", "has", "yes").collect()}
    assert got == {"d": True, "e": False}


def test_components(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {r.node: r.root for r in components(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_replies(spark):
    from folianth.operators import providers as P

    replies = ['{"author": " Ana Lee "}', '{"author": null}', "no json", '{"choice": 2}', '{"choice": -1}', '{"choice": 9}', '{"genres": ["SF", "Drama"]}', '{"genre": "SF"}', '{"genres": "SF"}', None]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(replies)], "path string, reply string")
    options = F.array(F.lit("A"), F.lit("B"))
    got = df.select(P.author_of(F.col("reply")).alias("a"), P.choice_of(F.col("reply"), options).alias("c"), P.genres_of(F.col("reply")).alias("g")).collect()
    assert [r.a for r in got] == ["Ana Lee"] + [None] * 9
    assert [r.c for r in got] == [None, None, None, "B"] + [None] * 6
    assert [r.g for r in got][6:] == [["SF", "Drama"], ["SF"], ["SF"], []]
    prompts = df.limit(2).select("path", P.author_prompt(F.col("path"), F.lit("f"), F.lit(None).cast("string"), F.lit("t"), F.lit("")).alias("prompt"))

    def provider(prompt):
        if "File: 0" in prompt:
            return '{"author": "X"}'
        raise ValueError("down")

    out = {r.path: (r.reply, r.error) for r in P.ask(prompts, provider).collect()}
    assert out["0"] == ('{"author": "X"}', None) and out["1"][0] is None and "down" in out["1"][1]


def test_executors_carry_out_plans(spark, tmp_path):
    from folianth.plans import executors

    src = tmp_path / "in" / "a.epub"
    src.parent.mkdir()
    src.write_bytes(b"x")
    out = str(tmp_path / "out")
    jobs = spark.createDataFrame([(str(src), str(src), "A B", None, "T", "epub"), (str(tmp_path / "no.epub"), "", "A B", None, "U", "epub"), (str(src) + "2", "", "A B", None, "V", "rtf")], "path string, original string, author string, coauthors array<string>, title string, format string")
    done = {r.path: (r.status, r.error) for r in executors.place(actions.place(jobs, out), convert=lambda a, b, fmt: "no", tag=lambda *a: None).collect()}
    assert done[str(src)] == ("done", None) and os.path.exists(f"{out}/A B/A B - T.epub")
    assert done[str(tmp_path / "no.epub")][0] == "failed" and done[str(src) + "2"] == ("failed", "no")
    moved = executors.move(spark.createDataFrame([(str(src), f"{out}/_Originals/a.epub"), (str(src), f"{out}/A B/A B - T.epub")], "src string, `to` string")).collect()
    assert [r.error is None for r in moved] == [True, False] and os.path.exists(f"{out}/_Originals/a.epub")


def test_converted_epubs_are_checked(spark):
    df = spark.createDataFrame([(bytearray(epub()),), (bytearray(epub(body="")),), (bytearray(b"PK"),), (None,)], "c binary")
    assert [r.p for r in df.select(files.epub_problem("c").alias("p")).collect()] == [None, "almost no text", "not a valid zip", "not a valid zip"]


def test_command_line(spark, tmp_path):
    from folianth import cli

    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "Ana Lee - One.epub").write_bytes(epub("One", "Ana Lee"))
    assert cli.main(["scan", "--library", str(tmp_path / "lib"), "--report", str(tmp_path / "r")]) == 0
    (tmp_path / "out").mkdir()
    assert cli.main(["apply", "--report", str(tmp_path / "r"), "--output", str(tmp_path / "out"), "--plan", str(tmp_path / "plan")]) == 0
    assert spark.read.parquet(str(tmp_path / "plan")).first().status == "done"


def test_command_line_resumes_and_undoes(spark, tmp_path):
    """A book without the right ending is placed by its content, parked, not placed again, and put back."""
    from folianth import cli

    lib, out, plan = tmp_path / "lib", tmp_path / "out", str(tmp_path / "plan")
    lib.mkdir(), out.mkdir()
    (lib / "Ana Lee - One.dat").write_bytes(epub("One", "Ana Lee"))
    assert cli.main(["scan", "--library", str(lib), "--report", str(tmp_path / "r")]) == 0
    apply = ["apply", "--report", str(tmp_path / "r"), "--output", str(out), "--plan", plan, "--library", str(lib)]
    assert cli.main([*apply, "--execute"]) == 0
    row = spark.read.parquet(plan).first()
    assert (row.status, row.format) == ("done", "epub") and (out / "Ana Lee" / "Ana Lee - One.epub").exists()
    assert not (lib / "Ana Lee - One.dat").exists() and (out / "_Originals" / "Ana Lee - One.dat").exists()
    assert cli.main(apply) == 0 and spark.read.parquet(plan).count() == 0
    assert cli.main(["undo", "--output", str(out), "--plan", plan, "--execute"]) == 0
    assert (lib / "Ana Lee - One.dat").exists() and not (out / "Ana Lee" / "Ana Lee - One.epub").exists()
    assert (out / "moves.undone.log").exists() and not (out / "moves.log").exists()
    assert not (out / "Ana Lee").exists() and not (out / "_Originals").exists()


def test_pruning_keeps_what_holds_a_file(spark, tmp_path):
    from folianth.plans import executors

    for x in ("a/b/c", "a/d", "e/f", "g"):
        (tmp_path / x).mkdir(parents=True)
    (tmp_path / "a" / "d" / "book.epub").write_bytes(b"x")
    (tmp_path / "e" / "f" / ".DS_Store").write_bytes(b"x")
    gone = {os.path.relpath(r.removed, tmp_path) for r in executors.prune(spark, str(tmp_path)).collect()}
    assert gone == {"a/b/c", "a/b", "e/f", "e", "g"} and (tmp_path / "a" / "d" / "book.epub").exists()
