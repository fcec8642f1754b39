"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page once. Its text falls into lines, one for each block element; a
line's ratio is its characters over the tags seen in it. The ratios, smoothed by a Gaussian, fall
into two clusters around a threshold. The text is where the upper cluster is: in the articles that hold much of it, or on pages
without any in the innermost region that holds nearly all of it, with upper lines and first headings beside that region. There
every line stays, however short. Parts that are plainly menus, notices and the like never count. A part whose name only has such a
word in it counts when most of its text is in the upper cluster, and a form when it is wrapped around most of that cluster with a hundred characters for
each of its controls.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.base import out_batch, query, rows, table, text_of

# Elements that begin a line, elements that are no part of a text, and words that mark such parts.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("""script style noscript template head title nav menu footer aside form dialog search button select option optgroup datalist textarea label
iframe object embed canvas svg math audio video map frameset noframes applet""".split())
MARKED = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion nav navbar navigation menu
menus topnav subnav breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead topbar toolbar comment comments commentlist disqus replies respond
cookie cookies consent gdpr notice notices alert banner banners popup modal overlay newsletter subscribe subscription signup login form share sharing social related
recommended recommendations skip pagination pager""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
REGION = frozenset("article main body html div section td".split())
#: Of the marking words those that also stand in other names; alone they mark a part like the rest.
UNSURE = frozenset("share form header status promotion banner notice notices alert social related".split())
CONTROLS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _outside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """2 for an element that is no part of a text, 1 for one that may be none, else 0."""
    if tag == "form":
        return 1
    if tag in OUTSIDE or tag == "header" and not in_article:
        return 2
    if tag in ("html", "body", "article", "main") and not attrs:
        return 0
    found = 0
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return 2
        if name == "role" and value in ROLES:
            return 2
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for word in value.split():
                parts = _WORD.findall(word)
                hit = [w for w in parts if w in MARKED]
                if not hit or in_article and parts == ["header"]:
                    continue
                if len(parts) == 1 or not UNSURE.issuperset(hit):
                    return 2
                found = 1
    return found


class _Lines(HTMLParser):
    """Lines as (text, tags, innermost region, innermost unsure element or -1, whether a heading); regions and unsure elements know the one around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it is a region, how far it is outside
        self.count: dict[str, int] = {}
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.kinds: list[str] = []
        self.parent: list[int] = []
        self.around: list[int] = []  # of each unsure element
        self.controls: list[int] = []  # of each unsure element: inputs for the reader in a form; -1 for other elements
        self.region = self.unsure = -1
        self.outside = self.articles = self.tags = self.headings = 0
        self.text: list[str] = []

    def _line(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.region, self.unsure, self.headings > 0))
        self.text, self.tags = [], 0

    def _pop(self, to: int):
        for tag, region, outside in reversed(self.open[to:]):
            self.count[tag] -= 1
            if region:
                self.region = self.parent[self.region]
                self.articles -= tag == "article"
            self.headings -= tag in HEADINGS
            if outside == 2:
                self.outside -= 1
            elif outside:
                self.unsure = self.around[self.unsure]
        del self.open[to:]

    def _close(self, tags, scope=frozenset()):
        if not any(self.count.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in tags:
                self._pop(at)
                return
            if self.open[at][0] in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self._line()
            self._close({"p"}, {"td", "th", "table", "button", "object", "caption"})
            if tag in SAME_ENDS:
                self._close(SAME_ENDS[tag], SCOPE[tag])
        self.tags += 1
        if tag in CONTROLS and self.unsure >= 0 and self.controls[self.unsure] >= 0 and dict(attrs).get("type") != "hidden":
            self.controls[self.unsure] += 1
        if tag in VOID:
            return
        if tag in ("article", "main", "body") and self.outside:  # an open menu or head never holds the article
            at = next((k for k, x in enumerate(self.open) if x[2] == 2), len(self.open))
            if at < len(self.open) and self.open[at][0] in OUTSIDE | {"header"}:
                self._pop(at)
        outside = _outside(tag, attrs, self.articles > 0)
        if tag in REGION:
            self.parent.append(self.region)
            self.region = len(self.kinds)
            self.kinds.append(tag)
            self.articles += tag == "article"
        self.headings += tag in HEADINGS
        self.open.append((tag, tag in REGION, outside))
        self.count[tag] = self.count.get(tag, 0) + 1
        if outside == 2:
            self.outside += 1
        elif outside:
            self.around.append(self.unsure)
            self.controls.append(0 if tag == "form" else -1)
            self.unsure = len(self.around) - 1

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._line()
        if tag == "p" and not self.count.get("p"):
            return
        self.tags += 1
        self._close({tag}, frozenset() if tag in REGION | {"html"} else {"article", "main"} if tag not in BLOCK else frozenset())

    def handle_data(self, data):
        if not self.outside:
            self.text.append(data)


def ratios(lines: list[tuple[str, int, int, int, bool]], sigma: float) -> list[float]:
    """Characters per tag of each line, smoothed by a Gaussian over the lines around it."""
    raw = [len(text) / max(tags, 1) for text, tags, *_ in lines]
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(raw)):
        near = range(max(0, i - reach), min(len(raw), i + reach + 1))
        out.append(sum(kernel[abs(i - j)] * raw[j] for j in near) / sum(kernel[abs(i - j)] for j in near))
    return out


def threshold(values: list[float]) -> float:
    """Half way between the means of the lower and the upper cluster."""
    low, high = min(values), max(values)
    for _ in range(30):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(below) / len(below) if below else low), (sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _sums(parent: list[int], own: list[int]) -> list[int]:
    """Totals of each node and all within it; a node's parent has a smaller number."""
    out = list(own)
    for i in range(len(out) - 1, -1, -1):
        if parent[i] >= 0:
            out[parent[i]] += out[i]
    return out


def _within(parent: list[int], chosen: set[int]) -> list[bool]:
    """Whether each node is one of the chosen or within one."""
    out: list[bool] = []
    for i, up in enumerate(parent):
        out.append(i in chosen or up >= 0 and out[up])
    return out


def main_text(html: str, sigma: float = 1.0, share: float = 0.9) -> str:
    """The article's lines, joined by two line ends; empty if there is no text.

    Articles count that hold at least a quarter as much of the upper cluster as the one that holds most; of equal regions the innermost.
    """
    p = _Lines()
    p.feed(html)
    p.close()
    p._line()
    if not p.lines:
        return ""
    cut = threshold(smooth := ratios(p.lines, sigma))
    upper = [v >= cut for v in smooth]
    if p.around:
        whole, above = [0] * len(p.around), [0] * len(p.around)
        for (text, _, _, unsure, heading), up in zip(p.lines, upper):
            if unsure >= 0:
                whole[unsure] += len(text)
                above[unsure] += len(text) * (up or heading)
        whole, above = _sums(p.around, whole), _sums(p.around, above)
        total = sum(len(x[0]) for x, up in zip(p.lines, upper) if up)
        bad = _within(p.around, {i for i, n in enumerate(p.controls) if 2 * above[i] < whole[i] or n >= 0 and (2 * above[i] < total or above[i] < 100 * max(n, 1))})
        keep = [i for i, x in enumerate(p.lines) if x[3] < 0 or not bad[x[3]]]
        p.lines, upper = [p.lines[i] for i in keep], [upper[i] for i in keep]
        if not p.lines:
            return ""
    mass, total = [0] * len(p.kinds), 0
    for (text, _, region, _, _), up in zip(p.lines, upper):
        if up:
            total += len(text)
            if region >= 0:
                mass[region] += len(text)
    mass = _sums(p.parent, mass)
    for kind in ("article", "main"):
        named = [r for r in range(len(mass)) if p.kinds[r] == kind and mass[r]]
        if named:
            most = max(mass[r] for r in named)
            inside = _within(p.parent, {r for r in named if 4 * mass[r] >= most})
            return "\n\n".join(x[0] for x in p.lines if x[2] >= 0 and inside[x[2]])
    best = max((r for r in range(len(mass)) if mass[r] and mass[r] >= share * total), default=-1)
    if best < 0:
        return "\n\n".join(x[0] for x in p.lines)
    inside = _within(p.parent, {best})
    here = [x[2] >= 0 and inside[x[2]] for x in p.lines]
    first = here.index(True)
    # beside the region a line needs the ratio itself, as smoothing lifts a menu next to long lines
    alone = [up and len(x[0]) >= cut * max(x[1], 1) for x, up in zip(p.lines, upper)]
    return "\n\n".join(x[0] for i, x in enumerate(p.lines) if here[i] or alone[i] or x[4] and i < first)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, sigma: float = 1.0, share: float = 0.9, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page, whatever its size; null html is empty and has an empty text.

    Character references are decoded, white space within a line is one space, a line break counts as white
    space. Rows may repeat and have null identifiers; other columns are ignored.
    """
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls in rows(batches, 64):
            texts = [main_text(h, sigma, share) for h in htmls]
            yield out_batch(SCHEMA, [ids, urls, texts, [len(t) for t in texts]])

    return pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), text_of(html_col)).mapInArrow(
        extracted, "page_id long, url string, text string, n_chars long")


@query("op4_html_text")
def op4_html_text(spark, base):
    return extract(table(spark, base, "pages"))
