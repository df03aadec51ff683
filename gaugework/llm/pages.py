"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing and clustering.

The parser's events cut a page into lines, one per block element. A line's ratio is its text outside
links over its tags; the ratios are smoothed by a Gaussian and split into two clusters by a
threshold. Articles that hold a line of the upper cluster are the main text, or else the main
element. On other pages the runs of the upper cluster are: in every container the lines from its
first to its last line of the cluster, and back to the heading that these stand under. What navigation, forms,
notices, adverts, comments and their like hold is left out; an article in a form or under a
class name that says so counts all the same, and a page that is one form is read as if it had none.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.arrow import arrow_schema

FEED = 1 << 16
SIGMA = 1.0
APART = 2.5  # the factor between the means of two clusters
# HTML elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br".split()
)
DROPPED = set("head title script style noscript template svg math canvas iframe object nav header footer aside button select textarea menu dialog".split())
CONTAINERS = set("body main article section div td table center blockquote".split())
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSED_BY_BLOCK = {"p"}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NOT_CONTENT = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead comment comments disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget widgets pagination pager toolbar".split()
)
OF_READERS = set("comment comments disqus replies respond related recommended recommendations".split())  # articles in them are none
# Words that only say where or what kind of thing a named block is.
NEUTRAL = set(
    "main top bottom left right center inner outer site page global primary secondary box container wrapper wrap section area block list item items bar content text "
    "link links head header title post posts article articles user form message button buttons btn icon icons panel module unit slot group row col column entry thread "
    "policy consent form signup body fixed sticky mobile desktop small large inline".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SEEN, SOFT, HARD = 0, 1, 2  # how a line is left out: not, unless an article begins, in any case


def told_by_names(names: str) -> int:
    """What class and id names say of a block; a name counts if it is a role as a whole, not if a part of it is."""
    found = SEEN
    for name in names.lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if not any(p in NOT_CONTENT for p in parts) or not all(p in NOT_CONTENT or p in NEUTRAL for p in parts):
            continue
        found = max(found, HARD if any(p in OF_READERS for p in parts) else SOFT)
    return found


class Line:
    __slots__ = ("parts", "links", "tags", "path", "dropped", "form", "heading")

    def __init__(self, path: tuple, dropped: int, form: bool, heading: bool):
        self.parts, self.links, self.tags, self.path, self.dropped, self.form, self.heading = [], 0, 0, path, dropped, form, heading


class PageLines(HTMLParser):
    """Collects the lines of a page with the containers around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list = []  # (tag, dropped, path of containers, whether in a form)
        self.lines: list[Line] = []
        self.kinds: list[str] = []  # of containers
        self.anchors = 0
        self.line = Line((), SEEN, False, False)

    def state(self) -> tuple[int, tuple, bool]:
        return self.stack[-1][1:] if self.stack else (SEEN, (), False)

    def fresh(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        dropped, path, form = self.state()
        self.line = Line(path, dropped, form, bool(self.stack) and self.stack[-1][0] in HEADINGS)

    def pop(self, at: int) -> None:
        self.anchors -= sum(e[0] == "a" for e in self.stack[at:])
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        block = tag not in INLINE
        ends = IMPLIED_END.get(tag, CLOSED_BY_BLOCK if block else ())
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in ends:
                self.pop(at)
                break
            if self.stack[at][0] in CONTAINERS or self.stack[at][0] in DROPPED or self.stack[at][0] in ("ul", "ol", "dl"):
                break
        dropped, path, form = self.state()
        if tag not in VOID:
            named = dict(attrs)
            role = (named.get("role") or "").lower()
            told = told_by_names(f"{named.get('class') or ''} {named.get('id') or ''}") if tag not in ("html", "body", "main") else SEEN
            article = tag in ("article", "main") or role in ("main", "article")
            if article:
                told = HARD if told == HARD else SEEN
                out, form = max(HARD if dropped == HARD else SEEN, told), False
            else:
                hard = tag in DROPPED or "hidden" in named or role in ROLES
                out, form = max(dropped, HARD if hard else told), form or tag == "form" or role == "form"
            if tag in CONTAINERS or article:
                path = (*path, len(self.kinds))
                self.kinds.append("main" if tag == "main" or role == "main" else "article" if article else tag)
            self.stack.append((tag, out, path, form))
            self.anchors += tag == "a"
            if block or out != dropped or article:
                self.fresh()
        elif block:
            self.fresh()
        elif tag == "br":
            self.line.parts.append(" ")
        self.line.tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                before = self.state()
                self.pop(at)
                if tag not in INLINE or self.state() != before:
                    self.fresh()
                break
        self.line.tags += 1

    def handle_data(self, data):
        if self.line.dropped == SEEN:
            self.line.parts.append(data)
            if self.anchors:
                self.line.links += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(ratios, reach, mode="constant")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Two clusters by a threshold that is halfway between their means; one, if their means are close."""
    cut = values.mean()
    for _ in range(50):
        high, low = values[values >= cut], values[values < cut]
        new = (high.mean() + low.mean()) / 2 if len(high) and len(low) else cut
        if new == cut:
            break
        cut = new
    upper = values >= cut
    if upper.all() or values[upper].mean() < APART * values[~upper].mean():
        return np.ones(len(values), bool)
    return upper


def main_text(html: str | None) -> str:
    reader = PageLines()
    html = html or ""
    for a in range(0, len(html), FEED):
        reader.feed(html[a : a + FEED])
    reader.close()
    reader.fresh()
    texts = [" ".join("".join(line.parts).split()) for line in reader.lines]
    full = [i for i, t in enumerate(texts) if t]
    kept = [i for i in full if not reader.lines[i].form] or full
    if not kept:
        return ""
    lines = [reader.lines[i] for i in kept]
    plain = np.array([max(len(texts[i]) - reader.lines[i].links, 0) for i in kept])
    content = upper_cluster(smoothed(plain / np.maximum([line.tags for line in lines], 1))) & (plain > 0)
    if not content.any():
        content[:] = True
    return " ".join(texts[kept[k]] for k in sorted(main_lines(lines, content, plain > 0, reader.kinds)))


def main_lines(lines: list[Line], content: np.ndarray, worded: np.ndarray, kinds: list[str]) -> set[int]:
    """The places of the lines that are main text, given those of the upper cluster and those that are not all links."""
    upper = [k for k in range(len(lines)) if content[k]]
    for kind in ("article", "main"):
        regions = {c for k in upper for c in lines[k].path if kinds[c] == kind}
        if regions:
            return {k for k, line in enumerate(lines) if not regions.isdisjoint(line.path)}
    runs: dict[int, list[int]] = {}
    for k in upper:
        home = lines[k].path[-1] if lines[k].path else -1
        first, _ = runs.setdefault(home, [k, k])
        runs[home] = [first, k]
    found: set[int] = set()
    for home, (first, last) in runs.items():
        within = lambda k: home < 0 or home in lines[k].path
        at = first
        while at and within(at - 1) and worded[at - 1] and (lines[at - 1].heading or not lines[at].heading):
            at -= 1
        first = at if lines[at].heading else first
        found |= {k for k in range(first, last + 1) if within(k)}
    return found


def _extractor(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema
                )

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one space in page order. A null, empty or text-free page gives an empty text. Unclosed
    elements end with their container. Pages of any length are read whole, in stretches. Repeated
    rows give equal rows; other columns are ignored; an empty table gives an empty result.
    """
    fields = f"page_id {pages.schema[page_id].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string, n_chars long"
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    return source.mapInArrow(_extractor(arrow_schema(fields)), fields)
