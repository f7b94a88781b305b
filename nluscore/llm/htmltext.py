"""Main text of HTML pages: streaming parser events, text-to-tag ratios, smoothing, threshold clustering.

A page is read as a stream of standard-library parser events, without a tree. Each block (a line of
the page) gets its text-to-tag ratio: code points over tags met. The ratios, smoothed by a Gaussian
along the page, are cut into two clusters by an iterated threshold; lines of the upper cluster are
content. The region is the outermost articles that hold that content, or the element that does, widened to
its parents until one would add lines of links; every block of it is kept, short ones too, but for boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments), known by element, role or name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

# Fixed values of HTML.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody "
                  "td tfoot th thead title tr ul head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title nav footer aside form button select textarea iframe "
                   "object svg canvas audio video dialog menu datalist".split())
REGION = frozenset("html body main article section div td center".split())
#: a start tag closes open elements of these names first, up to the nearest listed holder
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
# Names that mark boilerplate, as whole parts of a class or id.
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
                  "cookies consent gdpr notice notification alert newsletter subscribe subscription signup login sidebar "
                  "sidenav widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share "
                  "sharing social related recommended recommendations comment comments respond replies disqus popup modal "
                  "overlay pagination pager toolbar skip paywall disclaimer".split())
# Of these, names that also drop an article inside another article or main.
COMMENTS = frozenset("comment comments replies".split())
HEADERS = frozenset(["header", "pageheader", "siteheader"])
WITH = frozenset("has with no without is".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SIGMA, SHARE = 1.5, 0.9


def _named(attrs: dict, inside: bool) -> bool:
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if (attrs.get("role") or "").lower() in ROLES or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
        return True
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [p.lower() for p in PART.findall(name)]
        if parts and parts[0] in WITH:
            continue
        whole = "".join(parts)
        if NAMES.intersection(parts) or whole in NAMES or not inside and (HEADERS.intersection(parts) or whole in HEADERS):
            return True
    return False


def _comment(attrs: dict) -> bool:
    return any(COMMENTS.intersection(p.lower() for p in PART.findall(name))
               for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split())


class Lines(HTMLParser):
    """Blocks of a page: text, tags met, the numbers of the region elements around each, and characters in links."""

    def __init__(self, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.stack: list[tuple[str, bool, bool]] = []  # name, starts a dropped part, is a region
        self.drop = self.article = self.anchors = 0
        self.regions: list[tuple[int, str]] = []
        self.made = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, tuple, int]] = []

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, tuple(self.regions), self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def pop(self) -> None:
        name, dropped, region = self.stack.pop()
        if name in BLOCK and not self.drop:
            self.cut()
        if dropped:
            self.drop -= 1
        if region:
            self.regions.pop()
        if name in ("article", "main"):
            self.article -= 1
        self.anchors -= name == "a"

    def close_to(self, names: set[str], holders: set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in holders:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in ("html", "body") and any(s[0] == tag for s in self.stack):
            return
        if tag == "body":
            self.close_to({"head"}, {"html"})
        if tag in BLOCK:
            # a block ends an open paragraph; one that holds blocks of its own starts a line
            self.close_to({"p"}, REGION | {"li", "blockquote", "table", "form", "figure", "dd", "aside", "nav", "header", "footer"})
            if not self.drop:
                self.cut()
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not self.drop:
                self.parts.append(" " if tag != "wbr" else "")
            return
        inside = self.article > 0
        dropped = tag in HIDDEN or tag == "header" and not inside
        if not dropped and self.by_name and tag not in ("html", "body", "main", "article"):
            dropped = _named(dict(attrs), inside)
        if self.by_name and tag == "article" and inside:
            dropped = _comment(dict(attrs))
        region = tag in REGION
        self.drop += dropped
        self.article += tag in ("article", "main")
        self.anchors += tag == "a"
        if region:
            self.made += 1
            self.regions.append((self.made, tag))
        self.stack.append((tag, dropped, region))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe") and self.stack and self.stack[-1][0] == tag:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if any(s[0] == tag for s in self.stack):
            # an inline end tag doesn't close blocks
            if tag not in BLOCK and tag not in HIDDEN:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == tag:
                        break
                    if self.stack[k][0] in BLOCK:
                        return
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()
        elif tag in BLOCK and not self.drop:
            self.cut()

    def handle_data(self, data: str) -> None:
        if not self.drop:
            self.parts.append(data)
            if self.anchors:
                self.linked += sum(map(len, data.split()))

    def read(self, html: str) -> list[tuple[str, int, tuple, int]]:
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # a declaration the parser doesn't know: shown as text
            again = Lines(self.by_name)
            return again.read(html.replace("<![", "&lt;!["))
        while self.stack:
            self.pop()
        self.cut()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; weights are those within reach, so ends aren't darkened."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def threshold(values: np.ndarray) -> float:
    """Two clusters: the threshold settles half way between the means of what lies on its sides."""
    t = float(values.mean())
    for _ in range(50):
        low, high = values[values <= t], values[values > t]
        if not len(low) or not len(high):
            return float(values.min()) - 1.0
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _links(line: tuple[str, int, tuple, int]) -> bool:
    """Half of the line or more is link text, as in menus without a name."""
    return 2 * line[3] >= sum(map(len, line[0].split()))


def main_text(html: str | None) -> str:
    """Text of the page's article: blocks in page order, joined by newlines; empty if there is none."""
    if not html:
        return ""
    lines = Lines().read(html)
    if not lines:
        lines = Lines(by_name=False).read(html)
    if not lines:
        return ""
    length = np.array([len(x[0]) for x in lines], float)
    ratio = length / np.maximum(1, [x[1] for x in lines])
    wide = smoothed(np.log1p(ratio))
    content = wide > threshold(wide)
    mass = length * content
    held: dict[tuple, float] = {}
    outer: dict[tuple, float] = {}  # articles that no other holds
    for m, (_, _, around, _) in zip(mass, lines):
        for r in around:
            held[r] = held.get(r, 0.0) + m
        article = next((r for r in around if r[1] in ("article", "main")), None)
        if article:
            outer[article] = held[article]
    total = mass.sum()
    if outer and sum(outer.values()) >= 0.5 * total:
        return "\n".join(t for t, _, around, _ in lines if any(outer.get(r) for r in around))
    inner = [r for r in held if held[r] >= SHARE * total and r[1] not in ("html", "body")]
    if inner:
        region = max(inner)
        path = next(around for _, _, around, _ in lines if region in around)
        for parent in reversed(path[:path.index(region)]):
            if any(_links(x) for x in lines if parent in x[2] and region not in x[2]):
                break
            region = parent
        return "\n".join(t for t, _, around, _ in lines if region in around)
    # No element holds the content: the stretch from its first to its last line, widened up to lines of links.
    at = np.nonzero(content)[0]
    lo, hi = int(at[0]), int(at[-1])
    while lo > 0 and not _links(lines[lo - 1]):
        lo -= 1
    while hi + 1 < len(lines) and not _links(lines[hi + 1]):
        hi += 1
    return "\n".join(x[0] for x in lines[lo:hi + 1])


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null or empty html gives the empty text.

    One pass without a shuffle; repeated rows come out alike, extra columns are ignored.
    """
    d = need(pages, id_col, url, html).toDF("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
