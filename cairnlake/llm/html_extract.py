"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

A page streams through the standard library's parser and becomes lines, one for each block; what is never text
(scripts, styles, the head and the like) is left out. A line's ratio is its characters over its tags, and zero
where an element, role, class or id marks it as a menu, header, footer, sidebar, notice, advert, form or reader
comment. Ratios are smoothed by a Gaussian over neighbouring lines, and lines at or above the threshold (the
standard deviation of all ratios) are content. Content lines in a row form clusters; those that hold a fifth of
the largest one's text or more choose the region: the smallest section that holds them all, or the article or
main element around it. Unmarked lines of an article or main are kept, however short; in another region those
between content lines and those whose section holds content. So unmarked link lists, teasers and side columns
fall to the clusters, and marked lines can only lose by their marks.

Defined results: a null or empty page, and one without text, gives the empty string; repeated rows give one
row each; an empty table gives no rows; unclosed and stray tags are closed or ignored as browsers do in the
common cases; other columns are passed through, and text or n_chars among them are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, small_batches
from cairnlake.session import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas select textarea audio video".split())
MARKED = frozenset("nav header footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not article text, whatever stands beside them.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion
    nav navbar navigation navi breadcrumb breadcrumbs pagination pager sidebar sidebars footer footers colophon masthead topbar toolbar
    comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr newsletter popup modal
    related recommended recommendations signup login""".split()
)
#: Words that mark only where nothing but such words and PLAIN ones stands beside them: a share box, but no share price.
WEAK_MARKS = frozenset("menu menus header aside asides copyright notice notices alert banner banners overlay subscribe subscription share sharing social widget widgets search form".split())
PLAIN = frozenset("site page top bottom left right main global box bar list area block container wrap wrapper inner outer section primary secondary item items links buttons".split())
#: Of the marks, those that count on the elements that hold articles.
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended".split())
HOLDERS = frozenset(("article", "main", "body", "html"))
SECTIONS = frozenset(("article", "main", "section", "div", "td", "body", "html", "center", "table"))
#: A start tag of the first kind closes an open element of the second, unless one of the third stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIGMA, RADIUS = 1.0, 2
#: A cluster chooses the region if it holds this share of the largest cluster's characters.
LEAST_CLUSTER = 0.2


class _Lines(HTMLParser):
    """Collects (text, tags, marked, path) of every line; path: ids of open sections."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.names: list[str] = []  # of sections by id
        self._open: list[tuple[str, bool, bool]] = []  # tag, whether it has no text, whether it is marked
        self._path: list[tuple[int, int]] = []  # depth in _open, section id
        self._no_text = self._marked = 0
        self._text: list[str] = []
        self._tags = 0

    def _flush(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.lines.append((text, self._tags, self._marked > 0, tuple(i for _, i in self._path)))
            self._text.clear()
        self._tags = 0

    def _pop(self, to: int) -> None:
        while len(self._open) > to:
            _, no_text, marked = self._open[-1]
            section = bool(self._path) and self._path[-1][0] == len(self._open) - 1
            if section or marked:
                self._flush()
            self._open.pop()
            self._no_text -= no_text
            self._marked -= marked
            if section:
                self._path.pop()

    def _close(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            tag = self._open[i][0]
            if tag in tags:
                self._flush()
                self._pop(i)
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._flush()
        self._tags += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close({"p"}, SECTIONS | {"li", "blockquote", "dd"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        marked = _is_marked(tag, attrs, any(self.names[i] == "article" for _, i in self._path))
        if marked:
            self._flush()
        no_text = tag in NO_TEXT
        self._no_text += no_text
        self._marked += marked
        if tag in SECTIONS:
            self._path.append((len(self._open), len(self.names)))
            self.names.append(tag)
        self._open.append((tag, no_text, marked))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        self._tags += 1
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                self._pop(i)
                return

    def handle_data(self, data: str) -> None:
        if not self._no_text:
            self._text.append(data)

    def end(self) -> None:
        self.close()
        self._flush()


_WORDS = re.compile(r"[a-z0-9]+")


def _is_marked(tag: str, attrs: list, in_article: bool) -> bool:
    if tag in MARKED and not (tag == "header" and in_article):
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        value = value.lower()
        if name == "role" and value in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id"):
            for part in value.split():
                if part.startswith(("has-", "no-", "with-")):
                    continue
                words = {x for x in _WORDS.findall(part) if not x.isdigit()}
                if tag in HOLDERS:
                    if not ARTICLE_MARKS.isdisjoint(words):
                        return True
                elif not MARKS.isdisjoint(words) or (not WEAK_MARKS.isdisjoint(words) and words <= WEAK_MARKS | PLAIN):
                    return True
    return False


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios under a Gaussian of SIGMA over RADIUS neighbours; at the ends the weights that remain are scaled up."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    sums = np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)]
    return sums / np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]


def content_lines(lines: list[tuple[str, int, bool, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are content: their smoothed ratio of text to tags reaches the standard deviation of all; and which reach it unsmoothed."""
    open_ = np.array([not marked for _, _, marked, _ in lines])
    ratios = open_ * np.array([len(text) / (1 + tags) for text, tags, _, _ in lines])
    smooth = smoothed(ratios) * open_
    content = (smooth > 0) & (smooth >= smooth.std())
    return content, content & (ratios >= smooth.std())


def clusters(content: np.ndarray, strong: np.ndarray, paths: list[tuple[int, ...]], holders: list[int]) -> list[list[int]]:
    """Rows of content lines; a row ends where the article or main element around it does.

    Lines at a row's ends that only their neighbours' ratios lift belong to it where their section has a line that needs no lift.
    """
    found: list[list[int]] = []
    for i in np.flatnonzero(content).tolist():
        if found and found[-1][-1] == i - 1 and holders[i] == holders[i - 1]:
            found[-1].append(i)
        else:
            found.append([i])
    sections = {paths[i][-1:] for i in np.flatnonzero(strong).tolist()}
    held = [[i for i in c if strong[i] or paths[i][-1:] in sections] for c in found]
    return [[i for i in c if h[0] <= i <= h[-1]] for c, h in zip(found, held, strict=True) if h] or found


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.end()
    lines = page.lines
    if not lines:
        return ""
    is_holder = lambda i: page.names[i] in ("article", "main")
    content, strong = content_lines(lines)
    every = [path for *_, path in lines]
    found = clusters(content, strong, every, [next((i for i in reversed(path) if is_holder(i)), -1) for path in every])
    if not found:
        return ""
    sizes = [sum(len(lines[i][0]) for i in c) for c in found]
    large = [i for c, n in zip(found, sizes, strict=True) if n >= LEAST_CLUSTER * max(sizes) for i in c]
    # the sections around all of them, outermost first, and the smallest of these or the holder around it
    paths = [lines[i][3] for i in large]
    common = [x[0] for x in itertools.takewhile(lambda x: len(set(x)) == 1, zip(*paths, strict=False))]
    region = next((i for kind in ("article", "main") for i in common if page.names[i] == kind), common[-1] if common else None)
    whole = region is not None and is_holder(region)
    inside = [i for i, (*_, path) in enumerate(lines) if region is None or region in path]
    clustered = {i for c in found for i in c}
    chosen = [i for i in inside if i in clustered]
    sections = {lines[i][3][-1:] for i in chosen}
    return "\n".join(
        lines[i][0] for i in inside if i in clustered or not lines[i][2] and (whole or chosen[0] < i < chosen[-1] or lines[i][3][-1:] in sections)
    )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        names = [x for x in batch.schema.names if x != "__html"]
        texts = [main_text(x.as_py()) for x in batch.column("__html")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in names), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=[*names, "text", "n_chars"],
        )


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages' columns `keep` (all: None) with text and n_chars; one narrow pass, a page at a time."""
    names = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    wide = pages.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html}`").alias("__html"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields if f.name != "__html"]
    return wide.mapInArrow(_extracted, ", ".join([*kept, "text string", "n_chars bigint"]))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page of `pages`: page_id, url, its main text and the text's code points."""
    bounded_batches(spark)
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
