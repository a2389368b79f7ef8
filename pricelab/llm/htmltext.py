"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams events; block-level tags cut the page
into lines. A line's text-to-tag ratio is its characters over the tags seen
since the line before. Lines in elements that are boilerplate by their own
markup (navigation, header, footer, aside, form, script, hidden; adverts,
notices, comments and the like by class, id or role) have no text; a class or id
does not count for an element that holds the page's article or main. The ratios
are smoothed with a Gaussian; lines at or above the threshold (``level`` times
the standard deviation of the smoothed ratios) form clusters. The regions that
hold a cluster are kept: the article (or main) elements of a page that
marks them up, else each cluster from its first to its last line, with a heading directly before it.

Inside an article or main a class or id takes no text away by itself: headings are
named after what they say, sections after their subject. An element there whose name says
nothing but boilerplate (``ad-slot``, ``comment-list``; not ``share-price``) has its lines' smoothed
ratios lowered (times ``prior``) and compared with ``level`` times the mean of the lines outside such
elements as well; those that are in no cluster then go, all other lines of the region stay. Its header and labels are its own.

Null html counts as empty; a page without text gives an empty text, a page
whose lines are all below the threshold keeps all its lines (there is nothing
to tell them apart). Repeated rows are independent. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()) - {"br"}
NO_TEXT = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input label legend menu nav noscript object "
    "optgroup option script select style svg template textarea title video".split())
NO_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NO_NAME = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side|nav\w*|menus?|"
    r"breadcrumbs?|comments?|disqus|repl(?:y|ies)|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|"
    r"login|signup|search|toolbar|widgets?|pagination|pager|skip)$")
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
#: Words of a name after which the rest says what an element or its page has, lacks or shows, not what it is.
STATE = frozenset("and disable disabled enable enabled has have hide hides no non not plus show shows use uses with without".split())
#: Words that name the kind of box, not what is in it.
BOX = frozenset("area bar block box btn button buttons card container content form inner item items label link links list message post posts row section "
                "slot tile title top unit wrap wrapper".split())
GENERIC = re.compile(r"(?:widgets?|side|header|search|skip|pager|alert)$")  # say nothing of a part of an article
CONTENT = frozenset(("article", "main"))
SCOPE = frozenset(("html", "table", "td", "th", "caption", "template", "object", "marquee"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are text of the article whatever their name.
QUOTED = HEADING | frozenset(("blockquote", "q", "pre", "code", "figure", "figcaption", "table", "td", "th", "tr", "tbody"))
OWN = frozenset(("header", "label"))
#: Start tags that end an open element of the same kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in NO_TEXT:
        return True
    if tag in ("html", "body"):
        return False
    return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v and v.lower() in NO_ROLE for k, v in attrs)


def named(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """True if a class or id names the element as boilerplate."""
    if tag in CONTENT or tag in ("html", "body"):
        return False
    for name in (x for k, v in attrs if k in ("class", "id") and v for x in v.split()):
        for x in map(str.lower, NAME.findall(name)):
            if x in STATE:
                break
            if NO_NAME.match(x):
                return True
    return False


def boxed(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """True if, of an element inside an article, a class or id has only words of boilerplate and of boxes."""
    if tag in QUOTED:
        return False
    for k, v in attrs:
        if k == "class" or k == "id" and tag != "section":
            for name in (v or "").split():
                words = [x.lower() for x in NAME.findall(name)]
                if any(NO_NAME.match(x) and not GENERIC.match(x) for x in words) and all(x in BOX or x.isdigit() or NO_NAME.match(x) for x in words):
                    return True
    return False


class Lines(HTMLParser):
    """Of a page: runs of text between block tags, and which elements hold its regions (article or main)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.runs: list[tuple[list[tuple[str, tuple[int, ...], bool]], int, int, bool]] = []  # pieces, tags since the run before, region, heading
        # Tag, without text, elements around it that a class or id names, region, in a box of the region.
        self.stack: list[tuple[str, bool, tuple[int, ...], int, bool]] = []
        self.text: list[tuple[str, tuple[int, ...], bool]] = []
        self.tags = self.names = 0
        self.regions: list[tuple[str, tuple[int, ...]]] = []  # tag, named elements around it

    def flush(self) -> None:
        if any(not t.isspace() for t, *_ in self.text):
            region = self.stack[-1][3] if self.stack else 0
            self.runs.append((self.text, self.tags, region, any(t in HEADING for t, *_ in self.stack[-3:])))
            self.tags = 0
        self.text = []

    def lines(self) -> list[tuple[str, int, int, bool, bool]]:
        """(text, tags since the line before, region or 0, heading, all in a box of the region).

        A region in elements named as boilerplate counts if it is a main, or has more text than any region outside of
        them. The names of the elements that hold such a region (or, on a page whose regions are empty, any) do not count.
        """
        chars = [0] * (len(self.regions) + 1)
        for pieces, _, region, _ in self.runs:
            chars[region] += sum(len(t) for t, *_ in pieces)
        least = max((n for n, (_, names) in zip(chars[1:], self.regions) if not names), default=0)
        counts = [not names or n > 0 and (tag == "main" or n > least) for n, (tag, names) in zip(chars[1:], self.regions)]
        filled = any(c and n for c, n in zip(counts, chars[1:]))
        freed = {x for c, (_, names) in zip(counts, self.regions) if c or not filled for x in names}
        out, tags = [], 0
        for pieces, n, region, heading in self.runs:
            tags += n
            if region and not counts[region - 1]:
                continue
            text = " ".join("".join(t for t, names, _ in pieces if freed.issuperset(names)).split())
            if text:
                out.append((text, tags, region, heading, all(box or t.isspace() for t, _, box in pieces)))
                tags = 0
        return out

    def close_to(self, tags: set[str], stop: frozenset[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append((" ", (), False))
        if tag in BLOCK:
            self.flush()
            self.close_to({"p"}, SCOPE | CONTENT | {"div", "section", "li", "body", "blockquote"})
        if tag in ENDS:
            self.close_to(ENDS[tag], SCOPE - {"td", "th"} if tag == "tr" else frozenset({"ul", "ol", "dl", "table", "body", "select"}))
        if tag in VOID:
            return
        _, silent, names, region, box = self.stack[-1] if self.stack else ("", False, (), 0, False)
        silent = silent or boilerplate("div" if region and tag in OWN else tag, attrs)
        if region:
            box = box or boxed(tag, attrs)
        elif not silent and named(tag, attrs):
            self.names += 1
            names = (*names, self.names)
        if tag in CONTENT and not silent and not region:
            self.regions.append((tag, names))
            region, names = len(self.regions), ()
        self.stack.append((tag, silent, names, region, box))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # a slash does not close an html element
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.text.append((" ", (), False))
        self.close_to({tag}, SCOPE - {tag})

    def parse_marked_section(self, i, report=1):
        """'<![': a CDATA section that ends before the next '<![', or else a comment up to the next '>'."""
        if self.rawdata[i : i + 9].upper() == "<![CDATA[":
            end = self.rawdata.find("]]>", i + 9)
            if end >= 0 and self.rawdata.find("<![", i + 9, end) < 0:
                return end + 3
        return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        _, silent, names, _, box = self.stack[-1] if self.stack else ("", False, (), 0, False)
        if not silent:
            self.text.append((data, names, box))


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None, sigma: float = 1.0, level: float = 0.5, prior: float = 0.2) -> str:
    p = Lines()
    p.feed(html or "")
    p.close()
    p.flush()
    lines = p.lines()
    if not lines:
        return ""
    ratio = smooth(np.array([len(t) / max(1, n) for t, n, *_ in lines]), sigma)
    box = np.array([b for *_, b in lines])
    good = ratio >= min(level * ratio.std(), ratio.max())
    if box.any() and not box.all():  # boxes are measured by the lines outside of them, too
        good &= ~box | (prior * ratio >= level * max(ratio.std(), ratio[~box].mean()))
    if not good.any():
        good[:] = True
    region = np.array([r for _, _, r, *_ in lines])
    if region.any():
        marked = np.unique(region[region > 0])
        with_cluster = [r for r in marked if good[region == r].any()] or marked
        keep = np.isin(region, with_cluster) & (good | ~box)
    else:
        keep = good.copy()
        for k in range(len(lines) - 1):
            if lines[k][3] and keep[k + 1]:
                keep[k] = True
    return "\n".join(t for (t, *_), k in zip(lines, keep) if k)


def extract(html: Column, sigma: float = 1.0, level: float = 0.5, prior: float = 0.2) -> Column:
    """The main text of ``html``: its blocks in page order, one a line."""

    @F.pandas_udf("string")
    def html_main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x, sigma, level, prior) for x in s], dtype=object)

    return html_main_text(html)
