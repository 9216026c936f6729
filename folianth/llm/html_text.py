"""Main text of HTML pages by line-block distribution.

The markup is stripped into lines, one a block element. A line's weight is its text outside links;
lines of menus, page headers and footers, sidebars, notices, adverts, forms and comments, told by
element, role, class or id, weigh nothing. The weights are summed over a sliding window of lines:
the text surges where the sum passes a threshold and dives where it falls to zero, and the lines
between are kept; empty lines don't count. Paragraphs and headings beside text that surged (in the
same element) are kept as well, and so is what lies between, links too, unless it is longer than half
of the text.

Marks of the article are weights in the same windows. A line of an ``article`` (or ``itemprop=articleBody``) that
has text weighs the threshold more, so that short lines surge too; links in its paragraphs and headings are text;
runs of other links still dive, such as lists of further articles at its end. Lines outside weigh less than
nothing: the text dives there at once. ``main`` (or ``role=main``) without as much text in articles takes the
lines outside out in the same way, and its own lines weigh what they are. A page whose lines never reach the threshold is read with
none. A part with the name of a layout part (``sidebar-left``) that holds most of the page's text outside links is no such part.

White space in a line is one space, character references are decoded, kept lines are joined by one
line break. Null, empty and markup-only pages give the empty text; text without markup is one line. Pages of any length and
depth take time that grows with their length. Rows are independent: repeated rows give equal texts; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 3
#: Characters in a window at which unmarked text surges.
SURGE = 86

# Element names of the HTML standard by the part that they play here.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"noscript", "template", "head", "nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "svg", "canvas", "audio", "video", "annotation", "annotation-xml"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead",
    "tr", "ul",
}
SPACED = {"br", "td", "th"}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
#: How strongly an element marks the article.
MARKS = {"article": 2, "main": 1}
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "alertdialog", "dialog", "form"}
#: What marks a class or id of what isn't the article: the whole of it, its first word, or its last one.
WHOLE_OUT = re.compile(
    r"^(?:sponsor\w*|promo\w*|consent|notices?|alerts?|popup|modal|overlay|subscribe|signup|aside|respond|replies|related|recommend\w*|share|sharing|social|widgets?|pager|skip|"
    r"(?:share|sharing|social)(?:buttons?|links?|icons?|bar|media|list)|(?:post|entry|article)(?:share|sharing|social|related)|"
    r"related(?:posts?|articles?|links?|stories|content|items)|(?:recommended|sponsored|promoted)(?:posts?|articles?|links?|stories|content|items)|widgetarea|skiplink|"
    r"(?:modal|popup|newsletter)(?:overlay|dialog|window|form|box|content)|(?:signup|subscribe)(?:form|box))$"
)
FIRST_OUT = re.compile(
    r"^(?:ad|ads|adv|advert\w*|adsense|adbox|adslot|banner\w*|cookie\w*|gdpr|newsletter|nav|navbar|navigation|menu|menus|breadcrumb\w*|sidebar\w*|footer|masthead|toolbar|"
    r"comments?|commentlist|disqus\w*|pagination)$"
)
LAST_OUT = re.compile(r"^(?:ad|ads|advert\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|toolbar|banner|newsletter|comments|commentlist|pagination)$")
#: First or last words of what may be longer than the article.
TALK = {"comment", "comments", "commentlist", "respond", "replies"}
_name = re.compile(r"[a-z]+")
_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_attribute = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _names_out(value: str) -> str:
    """What a class or id of something beside the article says, or nothing; ``has-sidebar`` and ``no-ads`` tell of the page around it."""
    for part in value.split():
        words = _name.findall(part)
        if words and words[0] not in ("has", "no", "with", "without", "not") and (WHOLE_OUT.match("".join(words)) or FIRST_OUT.match(words[0]) or LAST_OUT.match(words[-1])):
            return "talk" if TALK & {words[0], words[-1]} or words[0].startswith("disqus") else "layout"
    return ""


def _is_out(name: str, attributes: str, inside: bool) -> tuple[bool, int, str]:
    """Whether an element is left out by what it is, how strongly it marks the article, and what its names say (see ``_names_out``)."""
    out, mark, named = name in SKIPPED or name == "header" and not inside, MARKS.get(name, 0), ""
    if attributes:
        for m in _attribute.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                if name not in ("body", "html", "article", "main"):
                    named = named or _names_out(value)
                elif name == "article" and any(_name.findall(x)[:1] == ["comment"] for x in value.split()):
                    named = "talk"  # comments are articles of their own
            elif key == "role":
                out, mark = out or value in ROLES_OUT, max(mark, value == "main")
            elif key == "itemprop":
                mark = max(mark, 2 * (value == "articlebody"))
            elif key == "aria-hidden":
                out = out or value == "true"
            elif key == "hidden":
                out = True
    return out, mark, named


class Element(NamedTuple):
    name: str
    left: bool  # out by what it or one around it is
    mark: int  # the strongest mark of the article on it or around it
    place: int  # of its tag
    part: int  # the innermost part out by its names that it is or is in, or -1


class Line(NamedTuple):
    chunks: list[tuple[str, int, bool]]  # text, part, whether in a link
    mark: int
    home: int  # the element around its block, by the place of its tag
    name: str  # of its block


class Part:
    """An element whose names say that it is beside the article."""

    def __init__(self, kind: str, mark: int, parent: int):
        self.kind, self.mark, self.parent, self.size, self.own = kind, mark, parent, 0, 0


def parse(page: str) -> tuple[list[Line], list[Part]]:
    """Lines in page order, without what is left out by what it is, and the parts that names leave out."""
    lines: list[Line] = []
    parts: list[Part] = []
    chunks: list[tuple[str, int, bool]] = []
    stack: list[Element] = []
    blocks: list[int] = []  # places in the stack of block elements
    cells: list[int] = []  # and of table cells
    count: Counter[str] = Counter()  # open elements by name
    unclosed: set[str] = set()
    now = outside = Element("", False, 0, -1, -1)

    def end_line() -> None:
        if any(x[0] and not x[0].isspace() for x in chunks):
            home, name = stack[blocks[-2]].place if len(blocks) > 1 else -1, stack[blocks[-1]].name if blocks else ""
            lines.append(Line(chunks.copy(), now.mark, home, name))
        chunks.clear()

    def close(k: int) -> Element:
        """Close the elements from place k of the stack on."""
        for x in stack[k:]:
            count[x.name] -= 1
        del stack[k:]
        for places in (blocks, cells):
            while places and places[-1] >= k:
                places.pop()
        return stack[-1] if stack else outside

    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not now.left:
            chunks.append((html.unescape(text), now.part, count["a"] > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCKS:
            end_line()
        elif name in SPACED:
            chunks.append((" ", now.part, False))
        if m[1]:
            if count[name] > 0:
                now = close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            continue
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end:
                at = page.find(">", end.start()) + 1 or n
            elif name in ("script", "style"):
                at = n
            else:
                unclosed.add(name)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in BLOCKS and blocks:  # an open paragraph, item or row ends here
            closes = {"p", "li"} if name == "li" else {"p", "tr"} if name == "tr" else {"p", "dt", "dd"} if name in ("dt", "dd") else {"p"}
            if name == "tr" and cells and cells[-1] > blocks[-1]:
                now = close(cells[-1])
            elif stack[blocks[-1]].name in closes:
                now = close(blocks[-1])
        left, mark, names = _is_out(name, m[3], now.mark > 0)
        part = now.part
        if names and not left and not now.left:
            parts.append(Part(names, now.mark, part))
            part = len(parts) - 1
        if mark and part >= 0 and not left and not now.left:
            parts[part].mark = max(parts[part].mark, mark)
        (blocks if name in BLOCKS else cells if name in ("td", "th") else []).append(len(stack))
        now = Element(name, now.left or left, max(now.mark, mark), m.start(), part)
        stack.append(now)
        count[name] += 1
    end_line()
    return lines, parts


def _solid(text: str) -> int:
    return len(" ".join(text.split()))


def marked(lines: list[Line], parts: list[Part]) -> int:
    """The mark that tells the article: 2 unless ``main`` holds more text outside of articles, then 1; 0 on a page without.

    Text of no part tells it, or else that of parts that aren't reader comments.
    """
    talk = [False] * (len(parts) + 1)  # the last is for text of no part
    for i, p in enumerate(parts):
        talk[i] = p.kind == "talk" or talk[p.parent]
    for any_part in (False, True):
        sums = [0, 0, 0]
        for x in lines:
            sums[x.mark] += sum(_solid(t) for t, part, _ in x.chunks if part < 0 or any_part and not talk[part])
        if sums[1] or sums[2]:
            return 2 if sums[2] >= sums[1] else 1
    return 0


def kept_parts(lines: list[Line], parts: list[Part], mark: int) -> set[int]:
    """Parts that are no parts beside the article, as they hold most of the page's text outside links.

    From the outermost on, and if nothing else is left the largest one, layout before reader comments.
    """
    text = 0
    for x in lines:
        for t, part, linked in x.chunks:
            if not linked and x.mark >= mark:
                if part < 0:
                    text += _solid(t)
                else:
                    parts[part].own += _solid(t)
    for p in parts:
        p.size = p.own
    inner: dict[int, list[int]] = {}
    for i in range(len(parts) - 1, -1, -1):
        p = parts[i]
        inner.setdefault(p.parent, []).append(i)
        if p.parent >= 0:
            parts[p.parent].size += p.size
            parts[p.parent].mark = max(parts[p.parent].mark, p.mark)
    kept: set[int] = set()
    heap: list[tuple[bool, int, int]] = []
    layout = 0

    def offer(i: int) -> None:
        nonlocal layout
        p = parts[i]
        if p.size and p.mark >= mark:
            heapq.heappush(heap, (p.kind != "layout", -p.size, i))
            layout += p.size * (p.kind == "layout")

    for i in inner.get(-1, ()):
        offer(i)
    while heap and (heap[0][0] is False and -2 * heap[0][1] > text + layout or not text):
        beside, size, i = heapq.heappop(heap)
        layout += size * (not beside)
        text += parts[i].own
        kept.add(i)
        for k in inner.get(i, ()):
            offer(k)
    return kept


def distribution(weights: np.ndarray, window: int, threshold: int) -> np.ndarray:
    """Which lines lie between a surge and a dive of the windowed sums; at a line of negative weight the text dives."""
    n = len(weights)
    total = np.concatenate([[0], np.cumsum(np.maximum(weights, 0))])
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:-1]
    kept, i = np.zeros(n, bool), 0
    while i < n:
        if sums[i] <= threshold or weights[i] <= 0:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive] > 0 and weights[dive] >= 0:
            dive += 1
        start = i
        while start and weights[start - 1] > 0 and not kept[start - 1]:
            start -= 1
        kept[start:dive] = True
        i = dive
    return kept


def joined(kept: np.ndarray, lines: list[tuple[str, int, str]], weights: np.ndarray) -> np.ndarray:
    """Kept lines with paragraphs and headings beside them, and with short gaps between lines of one element; ``lines``: (text, home, name)."""
    homes = {lines[i][1] for i in np.flatnonzero(kept)}
    kept = kept | np.array([w > 0 and home in homes and name in TEXTUAL for w, (_, home, name) in zip(weights, lines)])
    most = int(weights[kept].sum()) // 2
    open_ = np.concatenate([[0], np.cumsum(np.where(kept, 0, [len(x[0]) for x in lines]))])
    out = np.concatenate([[0], np.cumsum(weights < 0)])
    last: dict[int, int] = {}
    change = np.zeros(len(lines) + 1, np.int64)
    for b in np.flatnonzero(kept):
        a = last.get(lines[b][1])
        if a is not None and open_[b] - open_[a] <= most and out[b] == out[a]:
            change[a] += 1
            change[b] -= 1
        last[lines[b][1]] = int(b)
    return kept | (np.cumsum(change)[:-1] > 0)


def main_text(page: str | None, window: int = WINDOW, threshold: int = SURGE) -> str:
    if not page:
        return ""
    lines, parts = parse(page)
    mark = marked(lines, parts)
    whole = kept_parts(lines, parts, mark)
    whole.add(-1)
    shown = [True] * (len(parts) + 1)  # the last is for chunks of no part
    for i, p in enumerate(parts):
        shown[i] = i in whole and shown[p.parent]
    found, weights = [], []
    for x in lines:
        text = " ".join("".join(t for t, part, _ in x.chunks if shown[part]).split())
        if not text:
            continue
        linked = sum(len(t) for t, part, link in x.chunks if link and shown[part])
        weight = max(0, len(text) - linked)
        if mark:
            weight = -1 if x.mark < mark else len(text) if x.name in TEXTUAL else weight
        found.append((text, x.home, x.name))
        weights.append(weight + threshold if mark > 1 and weight > 0 else weight)
    if not found:
        return ""
    w = np.array(weights)
    kept = distribution(w, window, threshold)
    if not kept.any():
        kept = distribution(w, window, 0)
    if not kept.any():
        kept = w == w.max()  # links alone
    kept = joined(kept, found, w)
    return "\n".join(x[0] for x, k in zip(found, kept) if k)


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = WINDOW, threshold: int = SURGE) -> DataFrame:
    """``keep``, text, n_chars."""
    width = len(keep)

    def work(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), window, threshold) for x in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    picked = pages.select(*keep, F.col(page).alias("__page"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:width])
    return picked.mapInArrow(K.released(work), f"{fields}, text string, n_chars long")
