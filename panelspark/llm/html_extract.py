"""Operator 1: main text of HTML pages by text-to-tag ratio.

The standard library's parser streams events into lines (one per block element),
each with its text, the text within links, its number of tags and the section it
lies in.  Text-to-tag ratios are smoothed by a Gaussian over neighbouring lines and
split into two clusters.  From the page down, the section that holds the bulk of the
content cluster is entered; where that ends, the cluster decides what is kept: of
articles all that hold lines of it, else what lies between its first and last line
or beside one of them in a section.  Scripts, menus, footers and the like add no
lines; elements that their class, id or role marks are left out unless they hold
nearly the whole page.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, text_batches

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math nav footer aside button select textarea iframe object canvas audio video dialog menu head title datalist".split())
MARKED_TAGS = frozenset("form fieldset".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("html body article main section div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot"}

# Words in class, id or role that mark what is not content, and words that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related reply replies respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
BESIDE = frozenset("site main global top bottom left right primary secondary box bar list area section block container wrapper item items links link buttons button icons posts articles stories form slot unit message overlay signup side reader user thread rail".split())


def marks(value: str) -> bool:
    """Whether a name of the attribute consists of marking words, and words that go with them, alone: ``site-footer``, not ``with-sidebar``."""
    for name in value.lower().replace("_", "-").split():
        parts = [x for x in name.split("-") if x and not x.isdigit()]
        if any(x in MARKS for x in parts) and all(x in MARKS or x in BESIDE for x in parts) or name == "side-bar":
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, link characters, section) per block, and a tree of sections."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, section around it, drops
        self.open: dict[str, int] = {}
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.kind, self.marked = [-1], [""], [False]
        self.headings: set[int] = set()
        self.dropping = self.links = self.tags = self.linked = self.section = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            if any(self.open.get(h) for h in HEADINGS):
                self.headings.add(len(self.lines))
            self.lines.append((text, max(1, self.tags), min(self.linked, len(text)), self.section))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self) -> None:
        tag, section, drops = self.stack.pop()
        self.open[tag] -= 1
        self.dropping -= drops
        self.links -= tag == "a"
        self.section = section

    def _attributes(self, tag, attrs) -> tuple[bool, bool]:
        """Whether an element is hidden, and whether its names mark it."""
        hidden = marked = False
        for name, value in attrs:
            value = value or ""
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
            marked |= name in ("class", "id", "role") and tag not in ("html", "body") and marks(value)
        return hidden, marked

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if not self.dropping:
                self.tags += 1
                if tag == "hr":
                    self.flush()
                elif tag == "br":
                    self.parts.append(" ")
            return
        if tag in CLOSES_P and any(t == "p" for t, _, _ in self.stack[-4:]):
            self._close("p")
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == tag:
            self._close(tag)
        hidden, marked = self._attributes(tag, attrs) if attrs else (False, False)
        marked |= tag in MARKED_TAGS
        drops = hidden or tag in DROPPED or tag == "header" and not (self.open.get("article") or self.open.get("main"))
        if not self.dropping:
            self.tags += 1
            if tag in BLOCKS or drops or marked:
                self.flush()
        self.stack.append((tag, self.section, drops))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.dropping += drops
        self.links += tag == "a"
        if (tag in SECTIONS or marked) and not self.dropping:
            self.parent.append(self.section)
            self.kind.append(tag)
            self.marked.append(marked)
            self.section = len(self.parent) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while True:
            top, section, _ = self.stack[-1]
            if not self.dropping and (top in BLOCKS or top in DROPPED or section != self.section):
                self.flush()
            self._pop()
            if top == tag:
                return

    def handle_endtag(self, tag):
        if not self.dropping:
            self.tags += 1
        self._close(tag)

    def handle_data(self, data):
        if not self.dropping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self):
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian cut at three sigma; ends are weighted by what they have."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """Midpoint of two one-dimensional clusters, found by alternating means and midpoints from the mean on."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            return cut
        new = float(low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            return new
        cut = new
    return cut


def _passed_down(own: list[bool], parent: list[int]) -> list[bool]:
    """Whether a section or one around it has the property; sections stand after those around them."""
    out = list(own)
    for i in range(1, len(out)):
        out[i] = out[i] or out[parent[i]]
    return out


def _summed_up(own: list[float], parent: list[int]) -> list[float]:
    """What a section and those within it have together."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def _per_section(lines: list[tuple], n: int, weight) -> list[float]:
    out = [0.0] * n
    for i, line in enumerate(lines):
        out[line[3]] += weight(i)
    return out


def _left_out(page: Lines, plain: list[int]) -> list[bool]:
    """Sections that marks leave out.  A mark on what holds nearly all text of a page, in three lines or more, doesn't count."""
    n, parent, marked = len(page.parent), page.parent, list(page.marked)
    chars = _summed_up(_per_section(page.lines, n, lambda i: plain[i]), parent)
    count = _summed_up(_per_section(page.lines, n, lambda i: 1), parent)
    while True:
        out = _passed_down(marked, parent)
        left = sum(c for c, line in zip(plain, page.lines, strict=True) if not out[line[3]])
        in_article = any(not out[i] and chars[i] and page.kind[i] in ("article", "main") for i in range(n))
        wide = [i for i in range(n) if marked[i] and chars[i] >= 0.5 * chars[0] and count[i] >= 3]
        if in_article or left >= 0.25 * chars[0] or not wide:
            return out
        marked[wide[0]] = False


def is_content(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Lines of the denser cluster of smoothed ratios."""
    smooth = smoothed(ratios, sigma)
    return smooth >= min(threshold(smooth), float(smooth.max()))


def extract(html: str | None, sigma: float = 1.5, share: float = 0.6) -> str:
    """Main text: the blocks of the content region, one per line.

    Null, empty and text-free pages give an empty string; of sections that hold
    equally much the first is entered.  Of articles side by side, those stay that hold
    dense lines or a quarter of the longest one's text.
    """
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    parent, kind, n = page.parent, page.kind, len(page.parent)
    plain = [len(t) - linked for t, _, linked, _ in page.lines]
    out = _left_out(page, plain)
    here = [i for i, line in enumerate(page.lines) if not out[line[3]]]
    if not here:
        return ""
    lines = [page.lines[i] for i in here]
    chars = [plain[i] for i in here]
    content = is_content(np.array([c / line[1] for c, line in zip(chars, lines, strict=True)]), sigma)
    own = _per_section(lines, n, lambda i: chars[i] if content[i] else 0.0)
    mass = _summed_up(own, parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
    region = 0
    while kind[region] not in ("article", "main"):
        best = max(children[region], key=lambda c: mass[c], default=-1)
        if best < 0 or not mass[best] or mass[best] < share * mass[region]:
            break
        region = best
    base = parent[region] if kind[region] == "article" and region else region
    within = _passed_down([i == base for i in range(n)], parent)
    around = _passed_down([i > 0 and kind[i] == "article" for i in range(n)], parent)
    length = _summed_up(_per_section(lines, n, lambda i: chars[i]), parent)
    articles = [i for i in range(1, n) if kind[i] == "article" and within[i] and not around[parent[i]] and length[i]]
    if articles and sum(mass[i] for i in articles) >= share * mass[base]:  # articles that hold the bulk of it are more exact
        least = 0.25 * max(length[i] for i in articles)
        chosen = {i for i in articles if mass[i] or length[i] >= least}
        within, region = _passed_down([i in chosen for i in range(n)], parent), articles[0]
    inside = [i for i, line in enumerate(lines) if within[line[3]]]
    if kind[region] not in ("article", "main"):
        dense = [i for i in inside if content[i]]
        first, last = (dense[0], dense[-1]) if dense else (0, len(lines))
        while first > 0 and here[first - 1] in page.headings and within[lines[first - 1][3]]:
            first -= 1
        inside = [i for i in inside if lines[i][2] <= 0.5 * len(lines[i][0]) and (first <= i <= last or own[lines[i][3]])]
    return "\n".join(lines[i][0] for i in inside)


def _extract(batches):
    for batch in batches:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (page_id, url, text, n_chars), one row per row of ``pages``; nulls in page_id and url pass through."""
    own = text_batches(pages).select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark, sf_dir):
    return extract_pages(load(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extract": op1_html_extract}
ORACLES: dict[str, str] = {}
