"""HTML extraction: text-to-tag ratios over streaming parser events.

The standard library's parser streams a page's events.  Block elements cut the
text into lines; a line's ratio is its characters over its tags.  Ratios are
smoothed with a Gaussian over neighbouring lines of a region, lowered where classes or ids
speak against a line (MARKED for each such element around it) or where the page
has an article, or else a headline, and the line isn't in its region (OUTSIDE),
and clustered into two groups
by a threshold (two means in one dimension).

A region is the article or main element, or else the nearest division, that a
line stands in; a division with one line belongs to the one around it.  Regions
whose characters have a mean ratio over the threshold are content (and always
the best one), and all of their lines are kept, short ones too, but for lines
with more marks than the region itself that are under the threshold.  So the ratio decides about
every region, and a class never does alone: a mark is void if the article, main
element or headline is inside it.

Elements that hold no article text (menus, footers, asides, forms, scripts,
styles, headers outside the article, and what their role or style says is one)
are left out before.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

SIGMA, REACH = 1.0, 2
KERNEL = [exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "html hr legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: These always open a region that isn't content, and their text is never kept.
DROPPED = frozenset(
    "aside button canvas dialog fieldset footer form head iframe input math menu nav noembed noframes noscript object option script select style svg template textarea title audio video label datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of a class or id that mark something other than the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars side aside rail nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead footer footers comment comments commentlist disqus reply replies respond responses reactions discussion cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations widget widgets toolbar pagination pager skip search topbar alert disclaimer".split()
)
HEADERS = frozenset(("header", "topheader", "siteheader", "pageheader"))
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What a line's ratio is multiplied with for each mark, and outside the article.
MARKED, OUTSIDE = 0.1, 0.3
#: A mark around one of these is void.
VOIDS = frozenset(("article", "main", "h1"))
#: A class that begins so tells what else is on the page.
ABOUT = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "js-")


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's role or style says that it isn't the article."""
    for name, value in attrs:
        if name == "hidden" or value and (
            name == "role" and value.strip().lower() in ROLES or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and HIDDEN.search(value)
        ):
            return True
    return False


def _marked(attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element's class or id speaks against it."""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for word in value.split():
                if not word.lower().startswith(ABOUT) and any(
                    part in HINTS or part in HEADERS and not in_article for part in SPLIT.split(CAMEL.sub(r"\1-\2", word).lower())
                ):
                    return True
    return False


class Lines(HTMLParser):
    """The lines of one page: (text, tags, region, whether its elements can hold article text, marks around it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, tuple[int, ...]]] = []
        self.part: list[str] = []
        self.tags = 0
        #: open elements: tag, dropped, region, in an article, marks
        self.stack: list[tuple[str, bool, int, bool, tuple[int, ...]]] = [("", False, 0, False, ())]
        self.articles: set[int] = set()
        #: numbers of the headlines' lines
        self.headlines: set[int] = set()
        self.void: set[int] = set()
        #: of each region, the one around it
        self.around = [0]
        self.marks = 0

    def flush(self) -> None:
        if self.part:
            text = " ".join("".join(self.part).split())
            self.part.clear()
            if text:
                tag, dropped, region, _, marks = self.stack[-1]
                if tag == "h1":
                    self.headlines.add(len(self.lines))
                self.lines.append((text, self.tags, region, not dropped, marks))
                self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.part.append(" ")
        if tag in VOID:
            return
        stack = self.stack
        if tag in BLOCK:
            self.close_implied(tag)
        _, dropped, region, in_article, marks = stack[-1]
        if not dropped:
            dropped = tag in DROPPED or tag == "header" and not in_article or bool(attrs) and tag not in ("html", "body") and _hidden(attrs)
        if dropped:
            if not stack[-1][1]:
                self.flush()  # what stands before it in the line isn't dropped
            stack.append((tag, True, region, in_article, marks))
            return
        if tag in VOIDS:
            self.void.update(marks)
        if attrs and _marked(attrs, in_article):
            self.flush()
            self.marks += 1
            marks = (*marks, self.marks)
        if not in_article and tag in ("article", "main", "div", "section", "td", "body"):
            self.around.append(region)
            region = len(self.around) - 1
            if tag in ("article", "main") and len(marks) == len(stack[-1][4]):
                self.articles.add(region)
                in_article = True
        stack.append((tag, False, region, in_article, marks))

    def close_implied(self, tag: str) -> None:
        """Close an open p before a block, and an open item before the next one."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[k][0]
            if open_tag == "p" or open_tag in ends:
                del self.stack[k:]
                return
            if open_tag in BLOCK:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        stack = self.stack
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if stack[-1][1] and not stack[k - 1][1] or len(stack[-1][4]) > len(stack[k - 1][4]):
                    self.flush()
                del stack[k:]
                return
            if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def handle_data(self, data):
        self.part.append(data)


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian means of each ratio and its neighbours; beyond the ends there is nothing."""
    n, out = len(ratios), []
    for i in range(n):
        total = weight = 0.0
        for k in range(max(0, i - REACH), min(n, i + REACH + 1)):
            w = KERNEL[k - i + REACH]
            total += w * ratios[k]
            weight += w
        out.append(total / weight)
    return out


def split_point(values: list[float]) -> float:
    """The threshold between the two clusters of one-dimensional two-means that starts at the extremes."""
    low, high = min(values), max(values)
    for _ in range(20):
        middle = (low + high) / 2
        above = [v for v in values if v > middle]
        if not above or len(above) == len(values):
            return middle
        below_sum = sum(values) - sum(above)
        step = below_sum / (len(values) - len(above)), sum(above) / len(above)
        if step == (low, high):
            break
        low, high = step
    return (low + high) / 2


def main_text(html: str) -> str:
    """The article's blocks, joined by empty lines."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    possible = [k for k, line in enumerate(lines) if line[3]]
    if not possible:
        return ""
    held = Counter(lines[k][2] for k in possible)
    region, marked, rows = {}, {}, {}
    for k in possible:
        _, _, own, _, marks = lines[k]
        marked[k] = sum(m not in parser.void for m in marks)
        region[k] = parser.around[own] if held[own] == 1 and own not in parser.articles and not marked[k] and parser.around[own] not in parser.articles else own
        rows.setdefault(region[k], []).append(k)
    inner = parser.articles or {region[k] for k in possible if k in parser.headlines}
    ratio = {}
    for own in rows.values():
        for k, r in zip(own, smoothed([len(lines[k][0]) / max(1, lines[k][1]) for k in own]), strict=True):
            ratio[k] = r * MARKED ** marked[k] * (OUTSIDE if inner and region[k] not in inner else 1.0)
    threshold = split_point([ratio[k] for k in possible])
    weight, total = Counter(), Counter()
    for k in possible:
        n = len(lines[k][0])
        weight[region[k]] += n
        total[region[k]] += n * ratio[k]
    mean = {r: total[r] / weight[r] for r in weight}
    least = min(threshold, max(mean.values()))
    least_marks = {r: min(marked[k] for k in own) for r, own in rows.items()}
    return "\n\n".join(lines[k][0] for k in possible if mean[region[k]] >= least and (marked[k] == least_marks[region[k]] or ratio[k] >= least))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every page.

    A null or empty page, and one without content, has an empty text.  Every
    input row, repeated ones too, gives one row; other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keep)
    return pages.select(*keep, text_of(html).alias("_html")).mapInArrow(run, f"{kinds}text string, n_chars long")
