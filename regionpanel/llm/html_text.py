"""Main text of web pages by line-block distribution.

Markup is stripped into lines: block elements end a line, inline ones do not;
``br`` is white space.  A line's length is the text it brings as content, in
decoded characters: nothing inside scripts, styles, menus, headers, footers,
sidebars, forms, notices, adverts or reader comments (by element, role, or the
words of class and id; a heading's, a paragraph's or a section's only if the word
is nothing else, and never by an id that may be its title), and links count for nothing in the curve.

A word of class or id condemns no element with more than half of the page's
text, where text in a marked article (or main part) weighs ``WEIGHT`` times; for
adverts, notices and reader comments (``FOREIGN``) it takes nine tenths and no
article elsewhere.  Words after no, has, with and the like say nothing.

Lengths are summed over sliding windows of ``BLOCK`` lines.  Where the sum
rises over the surge threshold the text begins, back to the first line less
than a window away; where it falls to nothing it ends.  All lines between are
kept, short or links, in page order.  The threshold is ``SURGE`` characters, or
a share of the median line if that is less, so short pages have a surge too and
no single paragraph moves it.

An article mark is a weight and a boundary in that curve: lines in it weigh
``WEIGHT`` times and their links count, no window crosses its ends, a ``WEIGHT``-th
of the threshold is a surge in it, it is then taken from its first to its last
line, and other lines need ``WEIGHT`` times the threshold.  If the unmarked lines outweigh the marked ones
the mark says nothing (a teaser beside a plain body).

Null or empty html gives the empty string.  Truncated pages end with their
last line; unclosed elements end with their parent.  Repeated rows give
repeated results; an empty table an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import groupby
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import python_batches

BLOCK = 3
SURGE = 30
SURGE_SHARE = 0.25
WEIGHT = 4

#: fixed values: elements by their role in a page
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "canvas", "select", "annotation", "annotation-xml")
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset", "label", "option"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mstyle", "mspace", "msup", "msub", "msubsup",
          "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mpadded", "semantics"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"},
             "dd": {"dt", "dd"}, "option": {"option"}}
WORDS = ("ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsors nav navbar "
         "navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot header masthead topbar "
         "comment comments commentlist commentsection commentarea commentbox commentform commentthread disqus replies respond reply discussion notice notices cookie cookies consent gdpr alert popup modal "
         "overlay subscribe subscription newsletter signup login share sharing social related recommended toolbar pagination pager "
         "copyright legal disclaimer paywall").split()
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: words of what others put on the page
FOREIGN = set("ad ads advert adverts advertisement advertising adsense promo promoted promotion sponsor sponsored sponsors comment "
              "comments commentlist commentsection commentarea commentbox commentform commentthread disqus replies respond reply discussion notice notices cookie cookies consent gdpr related recommended".split())
#: the words after these tell what a wrapper has or lacks, not what it is
TELLS = {"no", "non", "not", "has", "have", "with", "without"}
_WORDS = set(WORDS)
#: elements whose id or class is about their text rather than their place in the page
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption", "section"}
#: words that title a part of an article as often as they name a part of a page
TITLES = set("discussion legal disclaimer notice notices related share sharing consent subscription promotion promotions alert "
             "response respond replies reply copyright header foot banner menu social navigation recommended advertising".split())

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PIECE = re.compile(r"[A-Za-z]+")


#: how much of the weighted text lifts a class word
_LAYOUT, _OTHERS = 0.5, 0.9


def _is_boiler(tag: str, attrs: str, in_article: bool) -> bool | float:
    """True: boilerplate whatever it holds; a number: boilerplate by a class word, up to that share of the text."""
    if tag in BOILER:
        return not (tag == "header" and in_article)
    if not attrs or tag in ("body", "html"):
        return False
    share = 0.0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                pieces = [x.lower() for x in _PIECE.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", word))]
                if tag in TEXTS and (name == "id" and (tag != "section" or word.lower() in TITLES) or not _WORDS.issuperset(pieces)):
                    continue
                for piece in pieces:
                    if piece in TELLS:
                        break
                    if piece in _WORDS:
                        share = max(share, _OTHERS if piece in FOREIGN else _LAYOUT)
    return share or False


class _Tags:
    """Where tags end, in one pass over the page: a quote that was found to open
    a run without end is never followed again."""

    def __init__(self, page: str):
        self.page, self.endless = page, set()

    def end(self, at: int) -> int:
        """Position of the ``>`` that ends the tag whose name ends at ``at``, quotes
        skipped; without one the page's end; where quotes never close, the next ``>``."""
        page, came, start = self.page, [], at
        while m := _STOP.search(page, at):
            if m.group() == ">":
                return m.start()
            close = -1 if m.start() in self.endless else page.find(m.group(), m.end())
            came.append(m.start())
            if close < 0:
                self.endless.update(came)
                plain = page.find(">", start)
                return plain if plain >= 0 else len(page)
            at = close + 1
        return len(page)


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, length without links, inside a marked article) of every content line."""
    out: list[tuple[str, int, int, tuple]] = []  # text, length, articles around, class-condemned elements around
    stack: list[tuple] = []  # element, is it boilerplate, is it an article, condemned elements from here on
    held: list[tuple[str, bool]] = []
    soft: list[tuple[float, bool, tuple]] = []  # of each condemned element: share that lifts it, is it an article, those around
    marks: list[tuple] = []  # condemned elements around each article
    boiler = article = anchors = 0
    around: tuple = ()

    def plain(parts):
        return _SPACE.sub(" ", entities.unescape("".join(parts))).strip()

    def flush():
        if held:
            text = plain(t for t, _ in held)
            if text:
                out.append((text, len(plain(t for t, link in held if not link)), article, around))
            held.clear()

    def close(depth: int):
        nonlocal boiler, article, anchors, around
        while len(stack) > depth:
            tag, bad, art, outer = stack.pop()
            open_tags[tag] -= 1
            if tag not in INLINE or outer != around:
                flush()
            boiler -= bad
            article -= art
            anchors -= tag == "a"
            around = outer

    at, n, tags, open_tags = 0, len(page), _Tags(page), Counter()
    while at < n:
        m = _OPEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not boiler:
            held.append((text, anchors > 0))
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        ends = tags.end(at)
        attrs, at = page[at:ends], min(n, ends + 1)
        if m.group(1) and not open_tags[tag]:
            if tag == "br" and not boiler:
                held.append((" ", False))
            continue
        if m.group(1):  # closing tag: ends its element and all unclosed ones in it
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if stack[depth][0] in ("article", "main", "body") and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not boiler:
                held.append((" ", False))
            continue
        if tag not in INLINE:
            while stack and stack[-1][0] in INLINE:  # a block ends open inline elements
                close(len(stack) - 1)
            if stack and stack[-1][0] in CLOSED_BY.get(tag, ()) or stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            flush()
        if attrs.rstrip().endswith("/"):
            continue
        kind = not boiler and _is_boiler(tag, attrs, article > 0)
        bad = kind is True
        art = tag in ("article", "main") or 'role="main"' in attrs
        if kind:
            flush()
        outer = around
        if kind and not bad:
            soft.append((kind, art, around))
            around += (len(soft) - 1,)
        elif art and not boiler and not bad:
            marks.append(around)
        stack.append((tag, bad, art, outer))
        open_tags[tag] += 1
        boiler += bad
        article += art
        anchors += tag == "a"
    flush()
    return _lifted(out, soft, marks)


def _lifted(found, soft, marks):
    """The lines outside condemned elements, after lifting those that hold the page's text."""
    def marked(articles, around):
        return articles > sum(soft[e][1] for e in around)

    inside, whole = [0] * len(soft), 0
    for text, size, articles, around in found:
        weight = WEIGHT * len(text) if marked(articles, around) else size
        whole += weight
        for e in around:
            inside[e] += weight
    keeps = [inside[e] > share * whole and (share == _LAYOUT or all(e in m for m in marks)) for e, (share, _, _) in enumerate(soft)]
    return [(text, size, articles > 0) for text, size, articles, around in found if all(keeps[e] for e in around)]


def _surges(size: list, surge: float):
    """[start, end) of every run from surge to dive."""
    window = [sum(size[i:i + BLOCK]) for i in range(len(size))]
    i = last = 0
    while i < len(window):
        if window[i] >= surge and size[i] > 0:
            j = i
            while j < len(window) and window[j] > 0:  # the dive: a whole window without text
                j += 1
            while near := [k for k in range(max(last, i - BLOCK), i) if size[k] > 0]:  # back to the first line of the text
                i = near[0]
            yield i, j
            i = last = j
        else:
            i += 1


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = lines(page)
    inside = WEIGHT * sum(len(text) for text, _, art in found if art)
    if inside <= sum(size for _, size, art in found if not art):
        found = [(text, size, False) for text, size, _ in found]
    size = [WEIGHT * len(text) if art else n for text, n, art in found]
    some = [n for n in size if n]
    if not some:
        return ""
    surge = min(SURGE, SURGE_SHARE * BLOCK * median(some))
    kept, at, boundary = [], 0, any(art for *_, art in found)
    for art, run in groupby(found, key=lambda x: x[2]):
        run = list(run)
        spans = list(_surges(size[at:at + len(run)], surge / WEIGHT if art else WEIGHT * SURGE if boundary else surge))
        at += len(run)
        if art and spans:
            spans = [(0, len(run))]
        kept += [text for i, j in spans for text, _, _ in run[i:j]]
    return "\n".join(kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    python_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
