"""Main text of web pages from streaming parser events.

The standard library's parser sends events. Blocks become lines, each with its text, its number of tags, and the
sectioning and boilerplate containers it stands in. What is boilerplate is decided once the page is read: a container of that
look which holds the page's main part is none. The text-to-tag ratio of each remaining line is smoothed with a Gaussian
kernel, and a two-means threshold splits lines into content and rest. Articles that hold most of the content are the content regions,
else the innermost container that holds nearly all of it; every line inside is returned, short ones too, and so are content lines beside it.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.llm.arrays import release

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template svg math canvas iframe object audio video map head title".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select textarea fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
REGIONS = frozenset("article main section div body td".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id values that mark boilerplate: alone, as the last word of a compound (`site-footer`), or as its first one
# before words of layout (`comment-list`). A compound that starts with a word of state (`has-sidebar`) tells of another element.
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead topbar footer foot sidebar side aside widget notice notices disclaimer announcement cookie cookies consent "
    "gdpr popup modal overlay toast alert paywall newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus replies reply respond pagination pager toolbar skip copyright".split()
)
LAYOUT = frozenset(
    "area bar block bottom box button buttons column container content form group holder inner item items left line link links list "
    "main outer panel right row section slot text thread title top unit widget widgets wrap wrapper wrapping zone".split()
)
STATE = frozenset("has have with without no not is show hide hidden allow".split())
WORDS = re.compile(r"[^_-]+")
SPACE = re.compile(r"\s+")
#: Elements that may stand in a head; any other start tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
# Elements without boilerplate, with text that is never shown, that look like boilerplate, and forms.
NEVER, HIDDEN, PLATE, FORM = range(4)
#: A container is no boilerplate if it holds articles with MAIN_SHARE of all text in articles and LEAST_SHARE of all text; in a page
#: without articles, a form with MAIN_SHARE of all text is none either.
MAIN_SHARE = 0.5
LEAST_SHARE = 0.2

SIGMA = 1.5


def named_boilerplate(name: str, in_article: bool) -> bool:
    """Whether one class name or id marks boilerplate."""
    words = WORDS.findall(name)
    if not words or words[0] in STATE:
        return False
    found = words[-1] if words[-1] in NAMES else words[0] if words[0] in NAMES and LAYOUT.issuperset(words[1:]) else ""
    return bool(found) and not (found == "header" and in_article)


def boilerplate_kind(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """How surely an element holds boilerplate. An article's own header, with its title, does not."""
    if any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs) and tag not in ("html", "body"):
        return HIDDEN
    if tag in ("button", "select", "textarea"):
        return HIDDEN
    if tag in BOILERPLATE:
        return NEVER if in_article and tag == "header" else FORM if tag in ("form", "fieldset") else PLATE
    if tag in ("html", "body", "main"):
        return NEVER
    for name, value in attrs:
        if name in ("class", "id") and value and any(named_boilerplate(x, in_article) for x in value.lower().split()):
            return PLATE
        if name == "role" and (value or "").lower() in ROLES:
            return FORM if value.lower() == "form" else PLATE
    return NEVER


class Blocks(HTMLParser):
    """Lines (text, tags, region, plate, is a heading) of the blocks in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, mute, plate, region
        self.mute = False
        self.region, self.regions = 0, 0
        self.parents = {0: 0}
        self.marked: set[int] = set()
        self.plate = 0
        self.plates = [(0, NEVER, 0)]  # parent, kind, region at its start
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        line = SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if line:
            heading = any(x[0] in ("h1", "h2") for x in self.open)
            self.lines.append((line, self.tags, self.region, self.plate, heading))
            self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in IN_HEAD and tag != "head" and any(x[0] == "head" for x in self.open):
            self.drop(next(k for k, x in enumerate(self.open) if x[0] == "head"))
        if tag in ENDS_PARAGRAPH:
            self.close_paragraph(tag)
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        kind = boilerplate_kind(tag, attrs, bool(self.marked) and self.in_article())
        if kind != NEVER and tag not in BLOCKS:
            self.cut()
        self.open.append((tag, self.mute, self.plate, self.region))
        self.mute = self.mute or tag in NO_TEXT
        if kind != NEVER:
            self.plates.append((self.plate, kind, self.region))
            self.plate = len(self.plates) - 1
        if tag in REGIONS:
            self.regions += 1
            self.parents[self.regions] = self.region
            self.region = self.regions
            if tag in ("article", "main"):
                self.marked.add(self.region)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def in_article(self) -> bool:
        return self.article(self.region) > 0

    def article(self, region: int) -> int:
        """The outermost article or main part that a region lies in; 0 outside."""
        found = 0
        while region:
            found = region if region in self.marked else found
            region = self.parents[region]
        return found

    def close_paragraph(self, tag: str) -> None:
        """A block ends an open paragraph, and an item the item before it."""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
        ends = ("p", *same.get(tag, ()))
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in ends:
                self.drop(k)
                return
            if name in BLOCKS:
                return

    def drop(self, k: int) -> None:
        self.cut()
        _, self.mute, self.plate, self.region = self.open[k]
        del self.open[k:]

    def handle_endtag(self, tag):
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS:
                    self.drop(k)
                elif any(x[0] in BLOCKS for x in self.open[k + 1 :]):
                    return  # an inline end tag does not close blocks
                elif self.open[k][2] != self.plate:
                    self.drop(k)
                else:
                    _, self.mute, self.plate, _ = self.open[k]
                    del self.open[k:]
                return

    def handle_data(self, data):
        if not self.mute:
            self.text.append(data)

    def shown(self) -> list[tuple[str, int, int, bool]]:
        """Lines (text, tags, region, is a heading) outside boilerplate."""
        of_articles, total, in_articles, held = [0] * len(self.plates), 0, 0, [0] * len(self.plates)
        for text, _, region, plate, _ in self.lines:
            chars, article = len(text), self.article(region)
            hidden, at = False, plate
            while at and not hidden:
                hidden, at = self.plates[at][1] == HIDDEN, self.plates[at][0]
            if hidden:
                continue
            total += chars
            in_articles += chars if article else 0
            while plate:
                held[plate] += chars
                parent, _, region_before = self.plates[plate]
                # Articles that start inside it; one around it tells nothing.
                of_articles[plate] += chars if article and article != self.article(region_before) else 0
                plate = parent
        gone = [False] * len(self.plates)
        for k, (parent, kind, _) in enumerate(self.plates[1:], 1):
            main = kind != HIDDEN and of_articles[k] >= max(MAIN_SHARE * in_articles, LEAST_SHARE * total, 1)
            most = kind == FORM and not in_articles and held[k] >= MAIN_SHARE * total
            gone[k] = gone[parent] or not (main or most)
        return [(text, tags, region, heading) for text, tags, region, plate, heading in self.lines if not gone[plate]]


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Flags of lines whose smoothed text-to-tag ratio belongs to the upper of two clusters."""
    reach = math.ceil(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.log1p(np.convolve(np.pad(ratios, reach, "edge"), kernel / kernel.sum(), "valid"))
    low, high = smooth.min(), smooth.max()
    if high - low < 1e-9:
        return np.ones(len(ratios), bool)
    for _ in range(20):
        limit = (low + high) / 2
        upper = smooth > limit
        next_low, next_high = smooth[~upper].mean(), smooth[upper].mean()
        if (next_low, next_high) == (low, high):
            break
        low, high = next_low, next_high
    return upper


def main_text(html: str | None) -> str:
    """The article of one page: blocks joined by line feeds. Empty for null, empty and text-free pages."""
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    page.cut()
    lines = page.shown()
    if not lines:
        return ""
    chosen = content_lines(np.array([len(text) / max(tags, 1) for text, tags, _, _ in lines], float))
    weight: dict[int, int] = {}
    articles = 0
    for (text, _, region, _), good in zip(lines, chosen):
        articles += len(text) if good and page.article(region) else 0
        while good:
            weight[region] = weight.get(region, 0) + len(text)
            if not region:
                break
            region = page.parents[region]
    total = weight.get(0, 0)
    if articles and articles * 2 >= total:
        return "\n".join(text for text, _, region, _ in lines if page.article(region))
    # The innermost region that still holds nearly all of the content.
    best = max((r for r in sorted(weight) if weight[r] * 10 >= total * 9), default=0)

    def inside(region: int) -> bool:
        while region and region != best:
            region = page.parents[region]
        return region == best

    return "\n".join(text for (text, _, region, heading), good in zip(lines, chosen) if good or heading or inside(region))


@F.arrow_udf(StringType())
def main_texts(column: pa.Array) -> pa.Array:
    made = pa.array([main_text(x.as_py()) for x in column], pa.string())
    release()
    return made


def extract_pages(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Every row of ``pages`` with the main text of the whole page in ``into`` (a column of that name is replaced).

    Null, empty and broken pages give what text they have, or an empty string. Repeated rows stay, and equal pages have equal
    texts. A very long page is read whole, in memory that grows with its lines. Other columns stay as they are.
    """
    return pages.withColumn(into, main_texts(F.col(html)))
