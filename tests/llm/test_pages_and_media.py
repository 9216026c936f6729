"""HTML main text and TIFF round trips."""

import hashlib
import struct
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folianth.llm import html_text, tiff

from .common import HAVE, SF, TEXTS, documents, empty, rows

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1>
<p><b>First   para<br>graph.<p>Second&nbsp;one &lt;x&gt;</p><aside>Side</aside><form>Name <input></form><p>Third.</p></article>
<div class="comments"><p>A comment that is long enough to be taken for text by its length alone, were it not for its class.</p></div>
<footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst para graph.\nSecond one <x>\nThird."


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<html></html>", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("a < b &am c &amp d", "a < b &am c & d"), ("<!-- c -->x<!-- open", "x")])
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


def test_unmarked_page_surges_and_dives():
    menu = "".join(f"<li><a href='#'>Item {i}</a></li>" for i in range(8))
    body = "".join(f"<p>{'A sentence of the main text that is rather long. ' * 3}{i}</p>" for i in range(4))
    page = f"<body><ul>{menu}</ul><div class='has-sidebar'><h2>Title</h2>{body}<p>Short end.</p></div><ul>{menu}</ul></body>"
    got = html_text.main_text(page).split("\n")
    assert got[0] == "Title" and got[-1] == "Short end." and len(got) == 6


LONG = "A sentence of the main text that is rather long. " * 3
MENU = "<ul>" + "".join(f"<li><a href='#'>Item {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("around", ["{}", "<div>{}</div>", "<div><div class='text'>{}</div><div>Copyright Foo</div></div>"])
def test_unmarked_page_keeps_headline_byline_links_and_short_paragraphs(around):
    links = "".join(f"<li><a href='#'>See {i}</a></li>" for i in range(5))
    article = f"<h1>Headline</h1><p>By Ann</p><p>{LONG}</p><p><a href='#'>One link</a></p><p>Short.</p><ul>{links}</ul><p>Shorter.</p><p>End.</p>"
    got = html_text.main_text(f"<body>{MENU}{around.format(article)}{MENU}</body>").split("\n")
    assert got == ["Headline", "By Ann", LONG.strip(), "One link", "Short.", *(f"See {i}" for i in range(5)), "Shorter.", "End."]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_wrappers_lose_no_article(tag):
    part = "<div class='elementor-element elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'><p>{}</p></div></div>"
    text = [LONG.strip() + str(i) for i in range(3)]
    inner = "".join(map(part.format, text))
    outs = "<div class='share-buttons'>Share it</div><div id='comments'><p>" + LONG * 9 + "</p></div>"
    for names in ("page", "sidebar-left", "share-content", "widget", "left-sidebar"):
        assert html_text.main_text(f"<body><{tag}><div class='{names}'>{inner}</div>{outs}</{tag}></body>").split("\n") == text
    nested = f"<body><div class='sidebar-left'><{tag}><div class='widget'>{inner}</div><div class='sidebar'>Beside it</div></{tag}></div></body>"
    assert html_text.main_text(nested).split("\n") == text
    assert html_text.main_text(f"<article><div class='comments'><p>{LONG}</p></div></article>") == LONG.strip()


def test_windows_choose_the_text_of_marked_pages(monkeypatch):
    """Lists of links at the end of an article, and what main holds besides text, are left by surge and dive, not by names."""
    links = "<ul>" + "".join(f"<li><a href='#'>Further article {i}</a></li>" for i in range(6)) + "</ul>"
    text = f"<h1><a href='#'>Head</a></h1><p>By Ann</p><p>{LONG}</p><p><a href='#'>One link</a></p><p>Short.</p>"
    want = ["Head", "By Ann", LONG.strip(), "One link", "Short."]
    article = f"<body>{MENU}<article>{links}{text}{links}</article><p>{LONG}</p></body>"
    main = f"<body>{MENU}<main>{links}<div>{text}</div>{links}<div>Alone</div><article><a href='#'>A teaser</a> of another page</article></main><p>{LONG}</p></body>"
    assert html_text.main_text(article).split("\n") == want
    assert html_text.main_text(main).split("\n") == want
    monkeypatch.setattr(html_text, "distribution", lambda w, window, threshold: w >= 0)
    assert html_text.main_text(article).split("\n") != want and html_text.main_text(main).split("\n") != want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-1, 0, 0, 1, 20, 60, 90, 200]), max_size=30), st.sampled_from([0, 86]))
def test_distribution_equals_a_plain_version(weights, threshold):
    n, kept, i = len(weights), set(), 0
    ahead = lambda i: sum(max(0, w) for w in weights[i : i + 3])
    while i < n:
        if weights[i] <= 0 or ahead(i) <= threshold:
            i += 1
            continue
        dive = next((k for k in range(i, n) if ahead(k) == 0 or weights[k] < 0), n)
        surge = i
        while surge > 0 and weights[surge - 1] > 0 and surge - 1 not in kept:
            surge -= 1
        kept |= set(range(surge, dive))
        i = dive
    got = html_text.distribution(np.array(weights, np.int64), 3, threshold)
    assert set(np.flatnonzero(got).tolist()) == kept


class Plain(HTMLParser):
    """The article of a page whose article is marked, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.out = 0
        self.lines, self.text, self.raw = [], [], None

    def cut(self):
        self.lines.append(" ".join("".join(self.text).split()))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.cut()
        self.inside += tag == "article"
        self.out += tag in ("nav", "aside", "footer", "form", "head") or "ad" in dict(attrs).get("class", "").split() or "comments" in dict(attrs).get("class", "").split()
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.cut()
        self.inside -= tag == "article"
        self.out -= tag in ("nav", "aside", "footer", "form", "head")

    def handle_data(self, data):
        if self.inside and not self.out:
            self.text.append(data)


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_pages_equal_a_plain_version(spark):
    for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet").collect():
        if "<article>" in (r.html or ""):
            plain = Plain()
            plain.feed(r.html[r.html.index("<article>") :])
            assert html_text.main_text(r.html).split("\n") == [x for x in plain.lines if x]


@pytest.mark.parametrize("page", [
    "<b>" * 8000 + "</i>" * 8000, "<b>" * 8000 + "<div>x</div>" * 4000, "<div>x" * 9000, "<div class='sidebar'>x" * 3000, "<ul><li>" * 4000 + "x</li>" * 4000,
    "<iframe>" * 8000 + "x", "<a>" * 8000 + "<p>x" * 5000, "<article>" + "<p>word " * 20_000,
])
def test_deep_and_long_pages_take_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 2
    assert html_text.main_text("<noscript>Turn it on" + "</noscript><p>Text") == "Text"
    assert html_text.main_text("<p>Text</p><textarea>open <p>more") == "Text\nopen\nmore"


def test_awkward_pages(spark):
    """Very long pages, equal pages, extra columns with names used inside."""
    long = "<article>" + "".join(f"<p>Paragraph {i}</p>" for i in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", long, "a", 1), (1, "u", long, "b", 2), (2, "v", "  ", None, None), (3, None, "<p></p>", "c", 3)], "page_id long, url string, html string, __page string, n_chars long")
    got = [(r.page_id, r.n_chars, r.text.count("\n")) for r in html_text.extract(df).collect()]
    n = sum(len(f"Paragraph {i}") for i in range(30_000)) + 29_999
    assert sorted(got) == [(1, n, 29_999), (1, n, 29_999), (2, 0, 0), (3, 0, 0)]


def test_comments_that_are_articles():
    comments = "".join(f"<article id='comment-{i}' class='comment even'><p>{LONG}{i}</p></article>" for i in range(5))
    for article in (f"<article class='post'><h1>Head</h1><p>{LONG}</p></article>", f"<main><h1>Head</h1><p>{LONG}</p></main>", f"<div><h1>Head</h1><p>{LONG}</p></div>"):
        assert html_text.main_text(f"<body>{article}<div>{comments}</div></body>").split("\n") == ["Head", LONG.strip()]


def test_formulas_and_objects_stay():
    math = "<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math>"
    assert html_text.main_text(f"<article><p>So {math} holds.</p><object data='a'><p>A chart</p></object></article>") == "So x=1 holds.\nA chart"


def test_pages_of_a_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, None), (None, "u", "<p>é", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[None].text == "é" and got[1].n_chars == len(got[1].text)
    assert html_text.extract(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_crosses_every_width():
    data = np.random.default_rng(0).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_tiff_round_trip(compression, predictor, tile, kind):
    rng = np.random.default_rng(4)
    pages = [rng.integers(0, 1 << 8, (37, 50, s)).astype(kind) for s in (1, 3)]
    data = tiff.write_tiff(pages, compression, predictor, strip_rows=8, tile=tile)
    got = [p for _, p in tiff.read_pages(data)]
    assert len(got) == 2 and all(np.array_equal(a, b) for a, b in zip(pages, got))


def test_damaged_files_are_rows(spark):
    good = tiff.write_tiff([np.zeros((2, 64), np.uint8)] * 2)
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(good[:20])), (5, bytearray(b"II*\0\x08\0\0\0\x01\0"))], "doc_id long, media binary")
    got = sorted((r.doc_id, r.page, r.error is None) for r in tiff.tiff_pages(df).collect())
    assert got == [(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, False), (4, 0, False), (5, 0, False)]


def test_texts_survive(spark):
    pages = tiff.tiff_pages(tiff.text_media(documents(spark)), keep=("doc_id", "n_bytes")).collect()
    assert len(pages) == len(rows())
    by = {(r[0], len((r[1] or "").encode())): (r[1] or "").encode() for r in rows()}
    for p in pages:
        raw = by[p.doc_id, p.n_bytes]
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (p.payload_bytes, p.payload_sha256, p.tail_crc32, p.error) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), None)
    assert len(TEXTS) and tiff.tiff_pages(tiff.text_media(empty(spark))).count() == 0


def packed(codes, widths):
    bits = "".join(f"{c:0{w}b}" for c, w in zip(codes, widths))
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def plain_lzw(data):
    """Codes read from a string of bits, their texts from a list."""
    bits, at, out, table, last = "".join(f"{x:08b}" for x in data), 0, b"", [], None
    while True:
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, last = [bytes((x,)) for x in range(256)] + [None, None], None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry


def test_decoders_on_bytes_of_others():
    """The published examples of both compressions, and an LZW decoder of another build."""
    stored = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    want = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.unpack_bits(stored) == want and tiff.unpack_bits(stored, 5)[:5] == want[:5]
    assert tiff.lzw_decode(packed([256, 7, 258, 8, 8, 258, 6, 6, 257], [9] * 9)) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(1)
    for data in (bytes(rng.integers(0, 4, 30_000, dtype=np.uint8)), b"ab" * 9000, bytes(rng.integers(0, 256, 20_000, dtype=np.uint8))):
        assert plain_lzw(tiff.lzw_encode(data)) == data == tiff.lzw_decode(tiff.lzw_encode(data))


@pytest.mark.parametrize("compression, pack", [(1, bytes), (8, zlib.compress), (32946, zlib.compress), (32773, lambda b: b"".join(bytes((0, x)) for x in b))])
def test_a_big_endian_file_written_by_hand(compression, pack):
    """Two pages of two strips each, 16 bits, with predictor 2 in the second."""
    pages = np.random.default_rng(2).integers(0, 1 << 16, (2, 5, 4), dtype=np.uint16)
    out, link = bytearray(b"MM\0*\0\0\0\0"), 4
    for k, page in enumerate(pages):
        rows = np.concatenate([page[:, :1], np.diff(page, axis=1)], axis=1) if k else page
        strips = [pack(rows[y : y + 3].astype(">u2").tobytes()) for y in (0, 3)]
        starts = [len(out), len(out) + len(strips[0])]
        out += b"".join(strips)
        out += b"\0" * (len(out) % 2)
        lists = len(out)
        out += struct.pack(">IIHH", *starts, *map(len, strips))
        out[link : link + 4] = struct.pack(">I", len(out))
        short = lambda tag, v: struct.pack(">HHIHH", tag, 3, 1, v, 0)
        tags = [short(256, 4), short(257, 5), short(258, 16), short(259, compression), struct.pack(">HHII", 273, 4, 2, lists), short(277, 1), short(278, 3), struct.pack(">HHIHH", 279, 3, 2, *map(len, strips)), short(317, 1 + k)]
        out += struct.pack(">H", len(tags)) + b"".join(tags)
        link = len(out)
        out += b"\0\0\0\0"
    got = [p for _, p in tiff.read_pages(bytes(out))]
    assert len(got) == 2 and all((a[:, :, 0] == b).all() for a, b in zip(got, pages))


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_claims_of_huge_pages_are_errors(compression):
    data = with_tags(tiff.write_tiff([np.zeros((4, 5), np.uint8)], compression), 0, {tiff.WIDTH: 1 << 30, tiff.LENGTH: 1 << 20})
    with pytest.raises(ValueError):
        list(tiff.read_pages(data))
    bomb = zlib.compress(b"\0" * 50_000_000)
    assert len(tiff.inflate(bomb, 1000)) == 1000 and len(tiff.lzw_decode(tiff.lzw_encode(b"a" * 100_000), 10)) < 5000
    wide = np.zeros((3000, 3000), np.uint8)  # compresses as far as it can
    assert (next(iter(tiff.read_pages(tiff.write_tiff([wide], compression, strip_rows=3000))))[1][:, :, 0] == wide).all()


def with_tags(data, page, values):
    """A file of ``write_tiff`` with values of tags of one page replaced."""
    out, at = bytearray(data), int.from_bytes(data[4:8], "little")
    for _ in range(page):
        at = int.from_bytes(out[at + 2 + 12 * int.from_bytes(out[at : at + 2], "little") :][:4], "little")
    for k in range(int.from_bytes(out[at : at + 2], "little")):
        place = at + 2 + 12 * k
        tag = int.from_bytes(out[place : place + 2], "little")
        if tag in values:
            out[place + 8 : place + 12] = values[tag].to_bytes(4, "little")
    return bytes(out)


def test_pages_after_a_damaged_one(spark):
    pages = [np.full((4, 5), i, np.uint8) for i in range(3)]
    for values in ({tiff.COMPRESSION: 99}, {tiff.STRIP_COUNTS: 1}, {tiff.BITS: 7}):
        data = with_tags(tiff.write_tiff(pages), 1, values)
        got = tiff.tiff_pages(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary"), pixels=True).orderBy("page").collect()
        assert [r.page for r in got] == [0, 1, 2] and [r.error is None for r in got] == [True, False, True]
        assert bytes(got[2].pixels) == pages[2].tobytes()


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_packed_samples(bits):
    want = np.random.default_rng(bits).integers(0, 1 << bits, (6, 13), dtype=np.uint8)
    packed = np.packbits(np.pad((want[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8) & 1).reshape(6, -1), ((0, 0), (0, -13 * bits % 8))), axis=1)
    data = with_tags(tiff.write_tiff([packed], tiff.PACKBITS), 0, {tiff.BITS: bits, tiff.WIDTH: 13})
    ((_, got),) = tiff.read_pages(data)
    assert (got[:, :, 0] == want).all()


def test_floating_point_predictor():
    want = np.random.default_rng(0).normal(size=(5, 7)).astype(">f4")
    planes = want.view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    stored = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1)
    data = with_tags(tiff.write_tiff([stored]), 0, {tiff.BITS: 32, tiff.WIDTH: 7, tiff.PREDICTOR: 3})
    ((_, got),) = tiff.read_pages(data)
    assert (np.ascontiguousarray(got[:, :, 0]).view(np.float32) == want).all()
