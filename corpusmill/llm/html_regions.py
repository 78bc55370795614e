"""Operator 3: main text of web pages by text-to-tag ratios over streaming parser events.

The standard library's parser feeds events to a builder that cuts the page into lines at block borders, menus, adverts and footers
too. Each line has a ratio of text to tags; the ratios are smoothed with a Gaussian and split into two clusters by a threshold. Lines
above it are the page's content, and what holds them is the content region: the articles most of whose text is content, else the
main element, else the innermost container with most of the content, of which parts that are mostly not content are left out. Inside
the region lines stay whole, short ones too, but for landmarks (menus, footers, asides, forms, dialogs) and containers whose class
or id is a plain name of adverts, side bars, notices or reader comments.

A container with such a name is not left out if it holds an article, the headline or most of the page's text. Names count on
containers only, as whole words: headings, paragraphs and names like ``related-work`` or ``social-policy`` don't.

Defined cases: null or empty html gives an empty text; unclosed and stray tags are tolerated; marked
sections of unknown kinds are comments; a tag or comment that never ends takes the rest of the page with it, as in browsers; nesting of any depth and very long
pages take linear time; a page with no markup is one line and is kept; articles that tie all stay; repeated rows and null ids are
taken each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is never shown, or never part of an article.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select option datalist button textarea input label".split())
ASIDE = frozenset("nav aside footer form dialog menu fieldset search".split())
REGIONS = frozenset(("article", "main"))
#: Elements that are followed through open and close tags; p, li and the like may stay open and only cut lines.
NESTED = SILENT | ASIDE | REGIONS | frozenset("header div section ul ol dl table tbody thead tfoot tr td th figure blockquote details body html center".split())
BREAKS = NESTED | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr address summary figcaption caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
#: Class words and ids of containers that are no part of an article.
MARKS = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies
    cookie-banner cookie-notice cookie-consent consent gdpr notice notices alert popup modal overlay newsletter newsletter-signup subscribe
    subscription paywall sidebar side-bar rail widget widgets related related-posts related-articles recommended recommendations teaser
    teasers share sharing share-buttons social social-links social-share follow comment comments comment-list commentlist comments-area
    disqus disqus_thread replies respond menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead login toolbar
    skip-link hidden site-header site-footer page-header page-footer""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")


def _named(attrs: list[tuple[str, str | None]]) -> bool:
    """Class or id names tell boilerplate; a wrapper may bear such a name too."""
    return any(value and (name == "class" and any(w in MARKS for w in value.lower().split()) or name == "id" and value.lower().strip() in MARKS) for name, value in attrs)


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Hidden, or of a role that is never content."""
    for name, value in attrs:
        if name in ("hidden", "aria-hidden") and (value or "true").lower() != "false":
            return True
        if not value:
            continue
        if name == "role" and value.lower().strip() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


UNENDED = re.compile("<[A-Za-z/!?]")


class Lines(HTMLParser):
    """The lines of a page (text, number of tags before and in it, innermost container, whether it is a heading) and the tree of containers as parents, each after its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent = ["page"], [-1]
        self.silent, self.out, self.named = [False], [False], [False]
        self.heads: set[int] = set()  # containers in which a headline or article starts
        self.open = [0]
        self.count: dict[str, int] = {}  # open containers by name
        self.hushed: str | None = None  # an open hidden paragraph, heading or span
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags, self.heading = 0, False

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.open[-1], self.heading))
            self.tags = 0
        self.text.clear()

    def shut(self) -> str:
        name = self.tag[self.open.pop()]
        self.count[name] -= 1
        return name

    def shut_to(self, *names: str) -> None:
        while any(self.count.get(n) for n in names):
            self.shut()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BREAKS:
            self.cut()
            self.hushed = None
            self.heading = tag in HEADINGS
        if tag in VOID:
            return
        if tag in REGIONS or tag in ("footer", "body"):
            # An article never lies in a menu or the page's head: one that was left open ends here.
            self.shut_to("nav", "head", "menu")
            if tag != "body" and self.count.get("header") and not any(self.count.get(r) for r in REGIONS):
                self.shut_to("header")
        if tag in REGIONS or tag == "h1":
            self.heads.add(self.open[-1])
        if tag in NESTED:
            inside = any(self.count.get(r) for r in REGIONS)
            plain = tag not in ("body", "html", "main")
            self.tag.append(tag)
            self.parent.append(self.open[-1])
            self.silent.append(self.silent[self.open[-1]] or tag in SILENT)
            self.out.append(tag in ASIDE or plain and _marked(attrs))
            self.named.append(plain and (tag == "header" and not inside or _named(attrs)))
            self.open.append(len(self.tag) - 1)
            self.count[tag] = self.count.get(tag, 0) + 1
        elif self.hushed is None and _marked(attrs):
            self.hushed = tag

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BREAKS:
            self.cut()
            self.heading = False
        if tag == self.hushed:
            self.hushed = None
        if self.count.get(tag) and tag not in ("body", "html"):
            while self.shut() != tag:
                pass

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BREAKS:
            self.cut()

    def parse_marked_section(self, i, report=1):
        """One of an unknown kind, or of none, is a comment up to the next bracket, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i + 3) + 1 or -1

    def close(self) -> None:
        # What is left begins with a tag, comment or declaration that never ends; as in browsers, it takes the rest with it.
        if UNENDED.match(self.rawdata):
            self.rawdata = ""
        super().close()

    def handle_data(self, data):
        if not self.silent[self.open[-1]] and self.hushed is None:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray, rounds: int = 50) -> float:
    """Border between two clusters of values, by Lloyd's steps on the line."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        cut = (low + high) / 2
        under, over = values[values < cut], values[values >= cut]
        if not len(under) or not len(over):
            return low
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Whether each line is content: its smoothed ratio of text to tags lies in the upper cluster."""
    ratios = smoothed(np.log1p(sizes / np.maximum(1, tags)))
    return ratios >= threshold(ratios)


def _held(page: Lines, values: np.ndarray) -> list[int]:
    """Sums of the lines' values in each container with all it holds."""
    held = [0] * len(page.tag)
    for (_, _, n, _), v in zip(page.lines, values.tolist()):
        held[n] += v
    for n in range(len(held) - 1, 0, -1):
        held[page.parent[n]] += held[n]
    return held


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.cut()
    if not page.lines:
        return ""
    sizes = np.array([len(t) for t, *_ in page.lines])
    weights = np.where(content_lines(sizes, np.array([n for _, n, *_ in page.lines])), sizes, 0)
    text, mass = _held(page, sizes), _held(page, weights)
    tag, parent, nodes = page.tag, page.parent, range(1, len(page.tag))
    heads = bytearray(len(tag))
    for n in page.heads:
        heads[n] = 1
    for n in reversed(nodes):
        heads[parent[n]] |= heads[n]
    # What is left out, and the outermost article or main element of each container.
    out, region = [False] * len(tag), [0] * len(tag)
    article = [0] * len(tag)
    for n in nodes:
        up = parent[n]
        wrapper = heads[n] or tag[n] == "article" and not (article[up] and page.named[n]) or 2 * text[n] > text[0]
        out[n] = out[up] or page.out[n] or page.named[n] and not wrapper
        article[n] = article[up] or (n if tag[n] == "article" and not out[n] else 0)
        region[n] = region[up] or (n if tag[n] == "main" and not out[n] else 0)
    articles = {n for n in nodes if article[n] == n and 2 * mass[n] >= text[n] > 0}
    if articles:
        most = max(mass[n] for n in articles)
        articles = {n for n in articles if 5 * mass[n] >= most}
        if 4 * sum(mass[n] for n in articles) >= mass[0]:
            return " ".join(t for t, _, n, _ in page.lines if article[n] in articles and not out[n])
    mains = [n for n in nodes if region[n] == n]
    best = max(mains, key=lambda n: (mass[n], -n), default=0)
    if not best or 4 * mass[best] < mass[0]:
        # The innermost container with most of the content that is not left out.
        own = _held(page, np.where([out[n] for _, _, n, _ in page.lines], 0, weights))
        best = 0
        for n in nodes:
            if parent[n] == best and 5 * own[n] >= 4 * own[0] > 0:
                best = n
    return " ".join(_parts(page, best, out, text, mass, weights))


def _parts(page: Lines, best: int, out: list[bool], text: list[int], mass: list[int], weights: np.ndarray) -> Iterator[str]:
    """Lines of the region: containers in it most of whose text is content, and lines of its own that are content, lie between such ones or are headings of what follows."""
    unit = [0] * len(page.tag)  # the part of the region that a container belongs to; the region's own number for itself
    unit[best] = best or -1
    for n in range(1, len(page.tag)):
        if n != best and unit[page.parent[n]]:
            unit[n] = n if page.parent[n] == best else unit[page.parent[n]]
    own = best or -1
    lines = [(t, unit[n], heading, w) for (t, _, n, heading), w in zip(page.lines, weights.tolist()) if unit[n] and not out[n]]
    sure = [w > 0 if u == own else 2 * mass[u] >= text[u] for _, u, _, w in lines]
    ahead = [False] * (len(lines) + 1)
    for k in range(len(lines) - 1, -1, -1):
        ahead[k] = ahead[k + 1] or sure[k]
    before, followed = False, [False] * (len(lines) + 1)
    for k in range(len(lines) - 1, -1, -1):
        followed[k] = sure[k] or lines[k][2] and followed[k + 1]
    for k, (t, u, heading, _) in enumerate(lines):
        if sure[k] or u == own and (before and ahead[k] or heading and followed[k + 1]):
            yield t
        before = before or sure[k]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. A row per row, where the page lies: no shuffle."""
    return pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
