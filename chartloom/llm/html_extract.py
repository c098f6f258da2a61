"""HTML extraction from a stream of parser events.

The standard library's parser turns a page into blocks: what stands between the starts and ends of block
elements, with references decoded, white space made single spaces and the tags counted. What lies in
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments (by element, or
by a name in class, id or role that marks such a part) is boilerplate. Each remaining block has a text-to-tag
ratio, its characters outside links over its tags; the ratios, smoothed by a Gaussian along the page, are split
by threshold clustering (two means of their logarithms), and the content is the region from the first to the last
block of the upper cluster, so that short paragraphs inside it stay. The region grows at either end over blocks
of running text (paragraphs, headings, list items and the like) without links, so that neither headings nor last
words are lost; lists of links and stray boxes at the ends go: a box at an end of the region that is no element of running text, and whose own ratio is
below that of the region's running text as a whole, is no part of it. So the region is right on pages that name none of their parts; names only correct it. Where a page names its article or main part, the same
happens among the blocks of those parts, of which the clustering decides between several.

A null or empty page gives the empty text. Broken, unclosed and cut markup is read as far as it goes. No
page or block is cut or dropped by size. Rows that repeat a page_id, or have none, are read each by its html; an empty
table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chartloom.llm.graph import bound_batches

#: Fixed values of HTML: elements without content, elements that break text into blocks, and raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never part of an article.
OUTSIDE = frozenset("nav header footer aside form script style noscript template iframe object svg math canvas audio video button select textarea input label dialog menu head title search datalist".split())
#: Names of parts that are boilerplate, in a class, id or role.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner navigation nav navbar menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo notice notices cookie cookies consent gdpr alert popup modal overlay"
    " comment comments disqus reply replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login search toolbar pagination pager widget form copyright legal disclaimer paywall toc".split()
)
#: What may follow such a name within a longer one: "comment-list", "ad-slot-2".
PARTS = frozenset("area bar block box buttons column container content form holder inner item items left links list menu panel placeholder region right row section slot text title top bottom unit widget widgets wrap wrapper".split())
#: What says, before such a name, that an element only has to do with one: "has-sidebar".
STATES = frozenset("has have is in no not off on show use uses with without".split())
#: Elements of running text, over which the region grows, and those of them that no class makes boilerplate.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset(("article", "main"))
_CUT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def marks(name: str) -> bool:
    """Whether one class, id or role names a part that is boilerplate: itself, by its last word, or by its first with a mere part of a page behind."""
    parts = [p.lower() for p in _CUT.split(name) if p]
    if not parts or (len(parts) > 1 and parts[0] in STATES):
        return False
    return parts[-1] in MARKS or (parts[0] in MARKS and all(p in PARTS or p in MARKS or p.isdigit() for p in parts[1:]))


class Blocks(HTMLParser):
    """Collects (text, tags, root, characters in links, whether it is running text) of every block outside boilerplate; root numbers the article or main part it is in, 0 for none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, bool, int]] = []  # (element, boilerplate begins here, its root)
        self.hidden = 0
        self.root = self.roots = 0
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            kind = next((t for t, _, _ in reversed(self.open) if t in BLOCKS), "")
            self.blocks.append((text, self.tags, self.root, self.linked, kind in TEXT))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                self._imply(tag)
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        hides = tag in OUTSIDE or self._marked(tag, attrs)
        self.hidden += hides
        self.links += tag == "a"
        self.open.append((tag, hides, self.root))
        if tag in ROOTS and not self.root and not self.hidden:
            self.roots += 1
            self.root = self.roots

    def _imply(self, tag) -> None:
        """An open element of the same kind ends here, unless a container stands between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                return self._close(k)
            if self.open[k][0] in BLOCKS:
                return None
        return None

    def _marked(self, tag, attrs) -> bool:
        if tag in ("html", "body", *ROOTS) or tag in HEADINGS:
            return False
        return any(k in ("class", "id", "role") and v and any(map(marks, v.split())) for k, v in attrs)

    def _close(self, k: int) -> None:
        for tag, hides, _ in self.open[k:]:
            self.hidden -= hides
            self.links -= tag == "a"
        self.root = self.open[k][2]
        del self.open[k:]

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                return self._close(k)
            if self.open[k][0] in ROOTS and tag not in ("body", "html", "main", "article"):
                return None  # a stray end can't leave the article
        return None

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """A Gaussian average along the page, its weights summing to 1 at the ends too."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / total


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """The members of the upper of two means; all, where they hardly differ."""
    low, high = values.min(), values.max()
    for _ in range(50):
        up = np.abs(values - high) <= np.abs(values - low)
        now = values[~up].mean() if (~up).any() else low, values[up].mean()
        if now == (low, high):
            break
        low, high = now
    return up if high - low > np.log(3) else np.ones(len(values), bool)


def main_text(html: str | None) -> str:
    """The text of a page's article, a block a line."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return ""
    chars, tags = (np.array(x, float) for x in zip(*((max(len(t) - linked, 1), max(n, 1)) for t, n, _, linked, _ in blocks), strict=True))
    content = upper_cluster(smoothed(np.log(chars / tags)))
    root = np.array([b[2] for b in blocks])
    among = np.ones(len(blocks), bool)
    if parser.roots and (root > 0).any():
        chosen = set(root[content & (root > 0)].tolist()) or set(root[root > 0].tolist())
        among = np.isin(root, list(chosen))
    found = region(np.flatnonzero(among), content, [running and not linked for _, _, _, linked, running in blocks])
    if not parser.roots:
        found = without_strays(found, chars, tags, np.array([running for *_, running in blocks]))
    return "\n".join(blocks[k][0] for k in found)


def without_strays(found: np.ndarray, chars: np.ndarray, tags: np.ndarray, running: np.ndarray) -> np.ndarray:
    """A region without the boxes at its ends that hold fewer characters a tag than its running text does; all of it, if it has none."""
    text = found[running[found]]
    if not len(text):
        return found
    stays = np.flatnonzero(running[found] | (chars[found] / tags[found] >= chars[text].sum() / tags[text].sum()))
    return found[stays[0] : stays[-1] + 1]


def region(of: np.ndarray, content: np.ndarray, grows: list[bool]) -> np.ndarray:
    """Of the blocks `of` those from the first to the last of the content, and at either end what it grows over; all, if none is content."""
    at = np.flatnonzero(content[of])
    if not len(at):
        return of
    a, b = at[0], at[-1] + 1
    while a > 0 and grows[of[a - 1]]:
        a -= 1
    while b < len(of) and grows[of[b]]:
        b += 1
    return of[a:b]


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return bound_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
