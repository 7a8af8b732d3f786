"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; nothing like a tree of the page is kept, only the stack of
open elements, and of containers their parents. Block-level tags end a line (a line is one block of the page). Each line
has its text, the number of tags met while it was open, its container, and whether it stands apart: in menus,
headers of the page, footers, asides, forms, dialogs, notices, adverts or comments, told by tag, by role or by a class or id
that names such a part and nothing else (``comment-list``, ``site-footer``; not ``comment-on-policy``).

Every line is scored, also those that stand apart: characters per tag, ``MARKED`` times that in an article or main element,
``APART`` times that apart. The ratios are smoothed by a Gaussian over neighbouring lines; lines above a share of the
standard deviation form clusters, and the dense lines of clusters with at least a third of the largest one's text are
chosen. The chosen lines that do not stand apart decide where the content is: in the innermost container that holds
nine tenths of their text, or one around it that has chosen lines of its own, or the article or main element around it. All its lines are content, however short, but
what stands apart, and headings right before it; outside an article or main element not its parts that hold no chosen line and are mostly links; where
the whole page is that container, only chosen lines, those between them and those of the same containers.
Chosen lines elsewhere are content too. If nothing but headings is left outside the parts that stand apart, the one of them (no menu,
footer or form) with the largest chosen text is content.

Defined results
  null, empty or tagless html: the text is what stands outside tags; empty if none.
  unclosed tags, broken references, unclosed comments: as the parser recovers them.
  ties: of equally large parts the first counts. Very long pages: whole. Repeated rows: alike. Empty table: empty result.
  Extra columns pass through; columns named text or n_chars are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import kept_columns, load, map_arrow, quoted, small_batches

#: Tags that end a line; fixed values.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no text of the page at all.
NEVER = frozenset("head title script style noscript template select datalist textarea iframe object canvas svg audio video map".split())
#: Tags of parts that stand apart, and those of them that are content in no case.
ASIDE = frozenset("nav footer aside form dialog menu".split())
CONTROLS = frozenset("nav footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words in class or id that name such a part, and those that may stand beside them.
MARKS = frozenset(
    "nav navbar navigation menu submenu sidebar sidebars aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus reply replies respond discussion footer masthead breadcrumb breadcrumbs share sharing social related recommended recommendations widget widgets toolbar pagination pager login search skip".split()
)
BESIDE = frozenset("list lists box area section wrapper wrap container inner outer block panel bar left right top bottom primary secondary site page main global header head buttons button links link items item posts post articles stories content group row col column slot unit form title body thread count the a".split())
CONTROL_MARKS = frozenset("nav navbar navigation menu submenu footer breadcrumb breadcrumbs pagination pager login search skip toolbar cookie cookies consent gdpr share sharing social comment comments commentlist disqus reply replies respond discussion ad ads adv advert adverts advertisement advertising adsense".split())
#: What a ratio counts for in an article or main element, and apart; fixed values.
MARKED, APART = 2, 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that hold blocks.
HOLDERS = frozenset("html body article main section div td center details blockquote figure fieldset aside nav footer header form dialog menu ul ol dl table hgroup address dir".split())
#: Those of them that are a piece of what stands around them.
PIECES = frozenset("blockquote figure ul ol dl table hgroup address dir td center".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Line(NamedTuple):
    text: str
    tags: int
    links: int  # characters inside links
    holder: int  # number of its container, in order of opening
    apart: int  # number of the outermost part around it that stands apart; -1 for none
    marked: bool  # in an article or main element
    heading: bool


def names_a_part(value: str) -> bool:
    """Whether a class or id value has a name that says such a part and nothing else."""
    for token in value.split():
        words = [w.lower() for w in _TOKENS.findall(token)]
        if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


class Lines(HTMLParser):
    """Streams a page into lines and the table of containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.pressed = self.in_link = self.in_button = 0
        self.parents, self.names, self.control = [-1], ["page"], {-1: False}  # of containers; control: parts that are content in no case
        self.open: list[tuple[str, bool, int, int, bool]] = []  # tag, never, holder, apart, marked

    def state(self) -> tuple[bool, int, int, bool]:
        return self.open[-1][1:] if self.open else (False, 0, -1, False)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            never, holder, apart, marked = self.state()
            if not never and 2 * self.pressed < len(text):  # not the label of a button by itself
                heading = any(t[0] in HEADINGS for t in self.open[-4:])
                self.lines.append(Line(text, max(1, self.tags), self.linked, holder, apart, marked, heading))
            self.tags = 0
        self.parts, self.linked, self.pressed = [], 0, 0

    def stands_apart(self, tag: str, attrs: list[tuple[str, str | None]], marked: bool) -> bool:
        if tag in ASIDE or tag == "header" and not marked:
            return True
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                return True
            if tag not in ("html", "body", "main") and v and (k == "role" and v.lower() in ROLES or k in ("class", "id") and names_a_part(v)):
                return True
            if k == "style" and v and re.search(r"display\s*:\s*none", v):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        never, holder, apart, marked = self.state()
        begins = not never and apart < 0 and self.stands_apart(tag, attrs, marked)
        if tag in BLOCK or tag in NEVER or begins:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "p":
            self.close("p", stop=BLOCK - {"p"})
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.close(tag, stop=frozenset("ul ol dl table menu select nav article main body".split()))
        never, holder, apart, marked = self.state()
        begins = begins and apart < 0
        self.in_link += tag == "a"
        self.in_button += tag == "button"
        if tag in HOLDERS or begins:
            self.parents.append(holder)
            self.names.append(tag)
            holder = len(self.parents) - 1
        if begins:
            apart = holder
            words = {w.lower() for k, v in attrs if k in ("class", "id") and v for w in _TOKENS.findall(v)}
            hidden = any(k == "hidden" or k == "aria-hidden" or k == "style" for k, _ in attrs)
            self.control[apart] = hidden or tag in CONTROLS or bool(words & CONTROL_MARKS) or any(k == "role" and (v or "").lower() in ROLES for k, v in attrs)
        self.open.append((tag, never or tag in NEVER, holder, apart, marked or tag in ("article", "main") and apart < 0))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1][0] == tag and tag in ("svg", "path", "g"):
            self.open.pop()

    def close(self, tag: str, stop: frozenset[str]) -> None:
        """Close the nearest open ``tag``, unless one of ``stop`` stands before it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for gone in self.open[i:]:
                    self.in_link -= gone[0] == "a"
                    self.in_button -= gone[0] == "button"
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in NEVER:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if self.open and self.open[-1][3] in range(len(self.parents)) and self.open[-1][0] == tag and tag not in BLOCK:
            if len(self.open) < 2 or self.open[-2][3] != self.open[-1][3]:
                self.end_line()  # an inline part that stands apart ends its line
        # an inline end tag closes nothing beyond its own block
        self.close(tag, stop=frozenset() if tag in BLOCK or tag in NEVER else BLOCK)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link or self.in_button:
            n = len(" ".join(data.split()))
            self.linked += n if self.in_link else 0
            self.pressed += n if self.in_button else 0

    def finish(self) -> list[Line]:
        super().close()
        self.end_line()
        return self.lines


def smoothed(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing with sigma = radius / 2, kernel renormalised at the ends."""
    sigma = radius / 2
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, k in zip(range(-radius, radius + 1), kernel, strict=True):
            if 0 <= i + d < len(values):
                total += k * values[i + d]
                weight += k
        out.append(total / weight)
    return out


def chosen_lines(lines: list[Line]) -> list[int]:
    """The dense lines of the large clusters."""
    own = [len(x.text) / x.tags * (MARKED if x.marked else 1) * (APART if x.apart >= 0 else 1) for x in lines]
    ratio = smoothed(own)
    mean = sum(ratio) / len(ratio)
    threshold = min(mean, math.sqrt(sum((x - mean) ** 2 for x in ratio) / len(ratio)))
    clusters: list[list[int]] = []
    for i, x in enumerate(ratio):
        if x >= threshold:
            if clusters and clusters[-1][-1] == i - 1:
                clusters[-1].append(i)
            else:
                clusters.append([i])
    size = lambda c: sum(len(lines[i].text) * (APART if lines[i].apart >= 0 else 1) for i in c)
    most = max(map(size, clusters))
    return [i for c in clusters if 3 * size(c) >= most for i in c if own[i] >= threshold]  # smoothing lifts the lines beside the content


def sums(parents: list[int], sizes: dict[int, int]) -> list[int]:
    """For each container the sizes in it and in those inside it; a container's number is larger than its parent's."""
    out = [sizes.get(i, 0) for i in range(len(parents))]
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def frame(page: Lines, holder: int) -> int:
    """The container, or the one around it that is no piece of what stands around it."""
    while holder > 0 and page.names[holder] in PIECES:
        holder = page.parents[holder]
    return holder


def root(page: Lines, chosen: list[int]) -> int:
    """The innermost container with nine tenths of the chosen text, or the article or main element around it."""
    sizes: dict[int, int] = {}
    for i in chosen:
        h = frame(page, page.lines[i].holder)
        sizes[h] = sizes.get(h, 0) + len(page.lines[i].text)
    total, at = sums(page.parents, sizes), 0
    for i in range(1, len(page.parents)):
        if page.parents[i] == at and 10 * total[i] >= 9 * total[0]:
            at = i
    while at > 0 and sizes.get(page.parents[at]):  # chosen lines right beside it
        at = page.parents[at]
    around, i = {}, at
    while i > 0:
        around[page.names[i]] = i  # the outermost of each name
        i = page.parents[i]
    return around.get("article", around.get("main", at))


def content(page: Lines) -> list[str]:
    lines = page.lines
    if not lines:
        return []
    chosen = chosen_lines(lines)
    if all(x.apart >= 0 or x.heading for x in lines):
        size: dict[int, int] = {}
        for i in chosen:
            if lines[i].apart >= 0 and not page.control[lines[i].apart]:
                size[lines[i].apart] = size.get(lines[i].apart, 0) + len(lines[i].text)
        shown = max(size, key=size.__getitem__, default=-1)
        return [x.text for x in lines if x.apart < 0 or x.apart == shown]
    free = [i for i, x in enumerate(lines) if x.apart < 0]
    chosen = [i for i in chosen if lines[i].apart < 0] or [i for i in free if 2 * lines[i].links < len(lines[i].text)] or free
    top = root(page, chosen)
    inside = [False] * len(page.parents)
    inside[top] = True
    for i in range(top + 1, len(inside)):
        inside[i] = inside[page.parents[i]]
    picked = set(chosen)
    has, text, links = ({}, {}, {})
    for i in free:
        x = lines[i]
        for t, n in ((has, i in picked), (text, len(x.text)), (links, x.links)):
            t[x.holder] = t.get(x.holder, 0) + n
    near = [False] * len(page.parents)
    for i in chosen:
        near[frame(page, lines[i].holder)] = True
    has, text, links = (sums(page.parents, t) for t in (has, text, links))
    marked, whole = page.names[top] in ("article", "main"), page.names[top] in ("page", "html", "body")
    aside = [not marked and not has[i] and 2 * links[i] >= text[i] for i in range(len(page.parents))]  # parts without chosen lines, mostly links
    for i in range(1, len(aside)):
        aside[i] = aside[i] or aside[page.parents[i]]
    for i in range(1, len(near)):
        near[i] = near[i] or near[page.parents[i]] and page.names[i] in PIECES and not aside[i]
    first, last = chosen[0], chosen[-1]
    keep = []
    for i in free:
        h = lines[i].holder
        if i in picked or inside[h] and not aside[h] and (not whole or first <= i <= last or near[h]):
            keep.append(i)
    k = free.index(keep[0])
    while k > 0 and lines[free[k - 1]].heading and not lines[keep[0]].heading:
        k -= 1
    return [lines[i].text for i in sorted({*keep, *free[k : free.index(keep[0])]})]


def main_text(html: str | None) -> str:
    page = Lines()
    page.feed(html or "")
    page.finish()
    return " ".join(content(page))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its html, with ``text`` and ``n_chars``."""
    small_batches(df.sparkSession)
    kept = kept_columns(df, [html, "text", "n_chars"])
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return map_arrow(df.select(*map(quoted, kept), F.col(html)), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLE = None
