"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; each block-level break ends a
line, which knows its text, the number of tags met in it and the
containers around it.  Text-to-tag ratios, smoothed by a Gaussian, are cut by
a threshold into content and the rest; runs of content lines are clusters.

The content region is found by the clusters' weight, the sum of their smoothed
ratios: from the whole page inwards, as long as one container holds
``MAIN_SHARE`` of the weight.  All lines of that container come out in page
order, so that a short line between long ones stays.  Where no container of
the page's body holds so much, those that hold a content line come out.

Names are a prior on top: elements and class names that mark boilerplate take a
line's ratio away and keep it out of the text; article and main elements with
content lines lie in the region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
#: Share of the clusters' weight from which a container is gone into.
MAIN_SHARE = 0.75

# Elements that end a line, elements without an end tag,
# elements that never hold main text, and words of class, id and role names
# that mark boilerplate.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup
    option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("""aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object
    script search select style svg template textarea title video""".split())
BOILER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs
    comment comments commentlist consent contentinfo cookie cookies disclaimer disqus footer gdpr hidden login masthead
    menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion
    recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription teaser toolbar widget widgets complementary dialog alert alertdialog""".split())
REGION_WORDS = frozenset("article articlebody main content post entry story".split())
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


class _Node:
    __slots__ = ("tag", "up", "boiler", "region")

    def __init__(self, tag: str, up: "_Node | None", boiler: bool, region: "_Node | None"):
        self.tag, self.up, self.boiler = tag, up, boiler
        self.region = region  # the nearest article or main element around


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, node)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = _Node("", None, False, None)
        self.lines: list[tuple[str, int, _Node]] = []
        self.parts: list[str] = []
        self.tags = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.node))
            self.tags = 0
        self.parts = []

    def _is_boiler(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in BOILER_TAGS or tag == "header" and self.node.region is None:
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none", value):
                return True
            if name in ("class", "id", "role") and value:
                found = {w.lower() for w in _WORDS.findall(value)}
                if found & BOILER_WORDS and not (tag == "article" and self.node.region is None and found & REGION_WORDS):
                    return True
                if "header" in found and self.node.region is None and tag != "article" and not found & REGION_WORDS:
                    return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self._end_line()
            self._close_implied(tag)
        if tag in VOID:
            return
        up = self.node
        boiler = up.boiler or self._is_boiler(tag, attrs)
        node = _Node(tag, up, boiler, up.region)
        if tag in ("article", "main") and not boiler:
            node.region = node
        self.node = node

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list items, cells and such end
        their like."""
        like = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}.get(tag, ()) + ("p",)
        stop = {"ul", "ol", "dl", "table", "body", "article", "main", "div", "section", "td", "th", "nav", "aside", "footer",
                "form", "header"} - set(like)
        n = self.node
        while n.up is not None and n.tag not in stop:
            if n.tag in like:
                self.node = n.up
            n = n.up

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        n = self.node
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.node = n.up

    def handle_data(self, data):
        if self.node.tag not in ("script", "style"):
            self.parts.append(data)

    def close(self):
        super().close()
        self._end_line()


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at three sigma and renormalised
    at the ends of the page."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    full = lambda v: np.convolve(v, kernel)[r:r + len(v)]
    return full(x) / full(np.ones(len(x)))


def line_weights(lines: list[tuple[str, int, _Node]], sigma: float = SIGMA) -> np.ndarray:
    """The smoothed text-to-tag ratio of each line that the threshold puts
    with the content, 0 for the others.  The threshold is one standard
    deviation of all smoothed ratios, or their mean if that is less."""
    ratio = np.array([0.0 if node.boiler else len(text) / max(1, tags) for text, tags, node in lines])
    s = smooth(ratio, sigma)
    return np.where((s >= min(s.std(), s.mean())) & (ratio > 0), s, 0.0)


def _parents(node: _Node) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.up


def _shared(nodes: list[_Node]) -> _Node:
    """The innermost container around all nodes."""
    common = list(_parents(nodes[0]))[::-1]
    for n in nodes[1:]:
        own = list(_parents(n))[::-1]
        k = 0
        while k < min(len(common), len(own)) and common[k] is own[k]:
            k += 1
        common = common[:k]
    return common[-1]


def main_container(nodes: list[_Node], weights: np.ndarray, share: float = MAIN_SHARE) -> _Node:
    """The innermost container that is reached from the page's root through
    containers with ``share`` of all weight each.  A container whose only
    line it is (a paragraph) is not gone into."""
    held: dict[int, float] = {}
    count: dict[int, int] = {}
    for node, w in zip(nodes, weights):
        for n in _parents(node):
            held[id(n)] = held.get(id(n), 0.0) + w
            count[id(n)] = count.get(id(n), 0) + 1
    whole = float(weights.sum())
    best = next(n for n in _parents(nodes[0]) if n.up is None)
    depth = 0
    for node, w in zip(nodes, weights):
        if not w:
            continue
        path = list(_parents(node))[::-1]
        for d, n in enumerate(path):
            if count[id(n)] < 2 or held[id(n)] < share * whole:
                break
            if d > depth:
                best, depth = n, d
    return best


def extract(html: str | None, sigma: float = SIGMA) -> str:
    """The main text, a line for each block; '' if there is none."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    keep = [not node.boiler for _, _, node in lines]
    if not any(keep):
        return ""
    nodes = [node for _, _, node in lines]
    weights = line_weights(lines, sigma)
    tagged = [node.region for node, k in zip(nodes, keep) if k and node.region is not None]
    hinted: list[_Node] = []
    if weights.any():
        # articles with content lines are in the region; with less than the
        # main share of the weight they are not alone, and all articles are
        inside = sum(w for node, w in zip(nodes, weights) if node.region is not None)
        alone = inside >= MAIN_SHARE * weights.sum()
        hinted = [node.region for node, w, k in zip(nodes, weights, keep) if node.region is not None and k and (w or not alone)]
        around = _shared([main_container(nodes, weights), *hinted])
    else:
        around = _shared(tagged) if tagged else None
    if around is None:
        return "\n".join(text for (text, _, _), k in zip(lines, keep) if k)
    chosen = [k and any(p is around for p in _parents(node)) for node, k in zip(nodes, keep)]
    if around.tag in ("", "html", "body") and weights.any():
        # no container stands out: those of the page that hold content lines
        below = [next((p for p in _parents(node) if p.up is around), node) for node in nodes]
        articles = {id(n) for n in hinted}
        content = {id(n) for n, node, w in zip(below, nodes, weights) if w or id(node.region) in articles}
        chosen = [c and id(n) in content for c, n in zip(chosen, below)]
    return "\n".join(text for (text, _, _), c in zip(lines, chosen) if c)


def extract_pages(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).  A
    null or empty page has the text ''; a page of any length is read whole;
    every row gives one row, whatever its id, and further columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), sigma) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
