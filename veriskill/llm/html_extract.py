"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. Line lengths (without link text) are summed over sliding
windows of lines; the text lies between the point where the sums surge and the point where they dive. That holds for
every page without an element that bounds its article. Tags and names weigh lines: elements called menus, adverts,
notices, reader comments and the like weigh nothing, unless one that a loose name or a form tag condemns holds the bulk
of the page. An element called the article, if it holds a quarter of the surging text, bounds the lines that take part;
there tags decide the result, from its first line with text of its own to its last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriskill.llm.common import column, map_arrow, table

#: Lines in a window, and the characters in one that make a surge.
WINDOW, SURGE = 3, 80
#: A region of surges stays if it has this share of the largest one's characters, where no element bounds them.
REGION = 0.2
#: Share of the surging text that makes an element called an article the page's, and not a teaser.
ARTICLE = 0.25
#: A loosely named element is spared if it has so many times the text of all that is not condemned; a plainly named one likewise.
LOOSE, PLAIN = 2, 8

#: HTML element names by role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select button".split())
NEVER = frozenset("nav footer aside menu dialog head".split())
FORMS = frozenset("form fieldset".split())
#: Elements whose open sibling ends where the next one begins.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Lines of these elements are text of the article, links or not.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role names that mark an element as no part of the article.
MARKS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies
adbox adslot footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification paywall sharebar topbar alert overlay pager pagination popup promo promotion recommended related
share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary search""".split())
#: Words of the same kind for what readers write.
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
EITHER = MARKS | READERS
#: Words that, beside marks, leave a name of several words a mark.
PLACES = frozenset("""area bar block body bottom box button buttons center container content field foot footer form frame group head header holder icon icons inner inline item items
left link links list main message outer page panel popup post posts primary right row secondary section side site slot story stories text title top unit wrap wrapper""".split())
#: First words of names that tell a state or a layout, not a role.
STATES = frozenset("has no with without not is hide show layout template theme".split())
#: Class and id names of page headers, as a whole.
HEADS = frozenset("header site-header page-header top-bar".split())
#: Words of class, id and role names of elements that hold the article where no element is called so.
HOLDERS = frozenset("article content entry main post story".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
#: Numbers of character references that are too long to be any character.
ENDLESS = re.compile(r"&#0*[1-9][0-9]{7,};?")
ZEROS = re.compile(r"&#0{8,}")


def unescaped(text: str) -> str:
    if "&#" in text:
        text = ZEROS.sub("&#0", ENDLESS.sub("�", text))
    return unescape(text)


def _condemned(name: str, attributes: str, inside: bool) -> str:
    """``never``, ``plain`` or ``loose`` for an element that is no part of the article, else nothing.

    ``inside`` the article a header is its own, and a name of several words is a mark only if all of them are marks or
    tell a place (``related-posts``, not ``related-work``).
    """
    worst = "never" if name in NEVER or (name == "header" and not inside) else "plain" if name in FORMS else ""
    if worst == "never" or not attributes:
        return worst
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if name in ("html", "body", "main"):
            continue
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDING.search(value)):
            return "never"
        if key in ("class", "id", "role") and not (name == "article" and not inside):
            if not inside and value in HEADS:
                return "never"
            for token in value.split():
                words = WORDS.findall(token)
                if not words or words[0] in STATES:
                    continue
                whole = all(w in MARKS or w in READERS or w in PLACES for w in words)
                if not READERS.isdisjoint(words) and (whole or len(words) == 2):
                    return "never"
                if not EITHER.isdisjoint(words) and (whole or not inside):
                    worst = "plain" if worst == "plain" or len(words) == 1 else "loose"
    return worst


def _holds(attributes: str) -> bool:
    return any(name.lower() in ("class", "id", "role") and not HOLDERS.isdisjoint(WORDS.findall(value.lower())) for name, value in ATTRIBUTE.findall(attributes))


class _Line:
    """Parts of text, each with the condemned element around it (0: none) and whether it is a link."""

    __slots__ = ("article", "held", "parts", "textual")

    def __init__(self, article: bool, held: bool, textual: bool):
        self.article, self.held, self.textual, self.parts = article, held, textual, []


class _Frame:
    """An open block element with the inline elements open in it."""

    __slots__ = ("article", "counts", "held", "inline", "link", "name", "node")

    def __init__(self, name: str, node: int, article: bool, held: bool, link: bool):
        self.name, self.node, self.article, self.held, self.link = name, node, article, held, link
        self.inline: list[tuple[str, int, bool]] = []  # name, and what held before it
        self.counts: dict[str, int] = {}


def lines_of(html: str) -> tuple[list[_Line], list[tuple[int, str]]]:
    """Lines of a page, and its condemned elements: the one around each and why; the first stands for the page."""
    nodes: list[tuple[int, str]] = [(0, "")]
    frames, open_blocks = [_Frame("", 0, False, False, False)], {}
    lines, line = [], _Line(False, False, False)

    def end() -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        top = frames[-1]
        line = _Line(top.article, top.held, top.name in TEXTUAL)

    def pop(name: str) -> None:
        """Close the open blocks down to the last of that name."""
        while True:
            top = frames.pop()
            open_blocks[top.name] -= 1
            if top.name == name:
                return

    at, size, last_end, quoted = 0, len(html), html.rfind(">"), True
    while at < size:
        start = html.find("<", at)
        if start < 0 or start > last_end:
            start = size
        top = frames[-1]
        if start > at:
            line.parts.append((html[at:start], top.node, top.link))
        if start == size:
            break
        if html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            at = close + 3 if close >= 0 else size
            continue
        if html.startswith("<![CDATA[", start):
            close = html.find("]]>", start)
            line.parts.append((html[start + 9 : close if close >= 0 else size].replace("&", "&amp;"), top.node, top.link))
            at = close + 3 if close >= 0 else size
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            at = html.index(">", start) + 1
            continue
        tag = TAG.match(html, start) if quoted else PLAIN_TAG.match(html, start)
        if tag is None and quoted and (tag := PLAIN_TAG.match(html, start)):
            quoted = False  # a quote takes the rest of the page: from here on the first > ends a tag
        if tag is None:
            line.parts.append(("<", top.node, top.link))
            at = start + 1
            continue
        at = tag.end()
        name, attributes = tag[2].lower(), tag[3]
        if tag[1]:  # an end tag
            if name in BLOCKS:
                end()
                if open_blocks.get(name):
                    pop(name)
                    end()
            elif top.counts.get(name):
                while True:
                    inner, node, link = top.inline.pop()
                    top.counts[inner] -= 1
                    top.node, top.link = node, link
                    if inner == name:
                        break
            continue
        if name in VOID:
            end() if name == "hr" else line.parts.append((" ", top.node, top.link))
            continue
        if name in RAW:  # their content is no markup
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = at if attributes.endswith("/") else close.end() if close else size
            line.parts.append((" ", top.node, top.link))
            continue
        if name in BLOCKS:
            end()
            if top.name == "p" or top.name in SIBLINGS.get(name, ()):
                pop(top.name)
                if name == "tr" and frames[-1].name == "tr":
                    pop("tr")
                top = frames[-1]
        if attributes.endswith("/") and name != "a":
            end() if name in BLOCKS else None
            continue
        inside = top.article or top.held
        why = _condemned(name, attributes, inside)
        node = top.node
        if why:
            nodes.append((node, why))
            node = len(nodes) - 1
        if name in BLOCKS:
            held = top.held or (name in ("div", "section", "td") and not inside and attributes != "" and _holds(attributes))
            frames.append(_Frame(name, node, top.article or name in ("article", "main"), held, top.link))
            open_blocks[name] = open_blocks.get(name, 0) + 1
            end()
        else:
            top.inline.append((name, top.node, top.link))
            top.counts[name] = top.counts.get(name, 0) + 1
            top.node, top.link = node, top.link or name == "a"
    end()
    return lines, nodes


def _spared(lines: list[_Line], nodes: list[tuple[int, str]]) -> list[bool]:
    """Which condemned elements take part after all: the heaviest first, while what takes part is far lighter."""
    own, fixed = [0] * len(nodes), 0
    for x in lines:
        for text, node, link in x.parts:
            if not link:
                n = len(text.strip())
                own[node] += n
                fixed += n if node == 0 and (x.article or x.held) else 0
    weight, inner = list(own), [[] for _ in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        inner[nodes[k][0]].append(k)
        weight[nodes[k][0]] += weight[k] if nodes[k][1] != "never" else 0
    spared = [k == 0 for k in range(len(nodes))]
    if fixed >= SURGE:  # the page calls another element its article
        return spared
    rest, heap = own[0], [(-weight[k], k) for k in inner[0] if nodes[k][1] != "never"]
    heap.sort()
    while heap:
        most, k = heappop(heap)
        if -most < SURGE or -most < (LOOSE if nodes[k][1] == "loose" else PLAIN) * rest:
            break
        spared[k] = True
        rest += own[k]
        for x in inner[k]:
            if nodes[x][1] != "never":
                heappush(heap, (-weight[x], x))
    return spared


def _sums(length: np.ndarray, window: int) -> np.ndarray:
    """The window that starts at each line."""
    return np.convolve(length, np.ones(window, int))[window - 1 :]


def regions(length: np.ndarray, window: int = WINDOW, surge: int = SURGE, share: float = REGION) -> list[tuple[int, int]]:
    """Line ranges from a surge to where the sums dive to nothing, those far lighter than the heaviest left out (under ``share`` of it).

    Where no window surges, half of the highest sum is a surge. Ranges begin and end with a line that has a length.
    """
    if not length.any():
        return []
    starts = _sums(length, window)
    level = min(surge, max(1, int(starts.max()) // 2))
    busy = np.concatenate(([0], np.cumsum(length > 0)))
    idle = np.flatnonzero(np.concatenate(([True], starts == 0, [True]))) - 1  # windows without any length, and both ends
    found = []
    for a, b in zip(idle[:-1].tolist(), idle[1:].tolist(), strict=True):
        if b - a > 1 and (starts[a + 1 : b] >= level).any():
            first, last = a + 1, min(b - 1 + window, len(length))
            lo, hi = np.searchsorted(busy, [busy[first] + 1, busy[last]])
            found.append((int(lo) - 1, int(hi), int(length[first:last].sum())))
    most = max(w for *_, w in found)
    return [(a, b) for a, b, w in found if w >= share * most]


def main_text(html: str | None, *, window: int = WINDOW, surge: int = SURGE) -> str:
    """Blocks of the main text, joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    lines, nodes = lines_of(html)
    live = _spared(lines, nodes)
    found = []  # text, length without links, in an article, in an element that holds one
    for x in lines:
        parts = [p for p in x.parts if live[p[1]]]
        text = " ".join(unescaped("".join(p[0] for p in parts)).split())
        if text:
            links = 0 if x.textual and (x.article or x.held) else sum(len(p[0].strip()) for p in parts if p[2])
            length = 0 if COPYRIGHT.match(text) and not (x.article or x.held) else max(0, len(text) - 2 * links)
            found.append((text, length, x.article, x.held))
    if not found:
        return ""
    length, article, held = np.array([f[1] for f in found]), np.array([f[2] for f in found]), np.array([f[3] for f in found])
    # Block text: lines in windows that surge.
    surging = np.convolve(_sums(length, window) >= surge, np.ones(window, int))[: len(found)] > 0
    weight = np.where(surging, length, 0)
    most = lambda mask, share: mask.any() and weight[mask].sum() >= share * weight.sum()
    inside = article if most(article, ARTICLE) else article | held if most(article | held, 0.5) else None
    if inside is None:
        return "\n\n".join(f[0] for a, b in regions(length, window, surge) for f in found[a:b])
    # in an element that bounds the article, all from the first line of text to the last belongs to it
    found, length = [f for f, k in zip(found, inside, strict=True) if k], length[inside]
    spans = regions(length, window, 1, 0.0)
    return "\n\n".join(f[0] for f in found[spans[0][0] : spans[-1][1]]) if spans else ""


def extract_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with the column ``text``: null or textless pages give an empty text, never null.

    Markup may be malformed: an unclosed element ends with its parent, an unclosed comment or script takes the rest of
    the page, as in browsers, and a tag without an end is text. Of regions with equal weights all stay, as do all
    articles of a page. Repeated rows get equal texts, empty tables stay empty, other columns pass through whatever
    their names; an input column ``text`` is replaced.
    """
    pages = pages.select(*(column(c) for c in pages.columns if c != "text" or c == html_col))
    names = pages.columns
    kept = [c for c in names if c != "text"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return map_arrow(pages, extract, StructType([f for f in pages.schema if f.name != "text"]).add("text", "string"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
