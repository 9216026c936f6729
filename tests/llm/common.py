"""Fixtures of awkward rows, and plain versions of the operators."""

import os
import re

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, th1 int, __ld_x int"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def words(t):
    return WORD.findall((t or "").translate(str.maketrans(UPPER, LOWER)))


TEXTS = [
    None, "", "   ", "\n", "\n\n", "a", "Hello World", LONG, LONG, LONG.upper(), LONG + " more", "one " + LONG, "Ünïcödé ßtraße Ærø " * 30,
    "the same line that many texts hold\n" + LONG, "the same line that many texts hold  \nother text of its own here", "  THE SAME line that many texts hold\t\nthird",
    "x\r\ny\r\nthe same line that many texts hold\r", "word " * 20000, "\x00nul\x00   sep \U0001f600", "short line\nshort line\nshort line", "tail\n",
]


def rows():
    """Ids with nulls, repeats of whole rows and of ids; extra columns whose names operators use inside."""
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", i, None) for i, t in enumerate(TEXTS)]
    return [*out, out[7], out[7], (3, "another text under an id that exists", "en", None, 0, None, None, 1), (None, LONG, None, None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
