"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postloom.llm.common import field, map_texts

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("script style noscript template head title iframe object svg math canvas audio video form button select option textarea label fieldset nav menu footer aside dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold running text; all other blocks are containers.
TEXT = HEADINGS | frozenset("p li pre dt dd blockquote td th caption figcaption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar tablist toolbar".split())
#: Words of class names and ids that stand for boilerplate, those that do so outside of articles only, and words of layout.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices newsletter".split())
COMMENTS = frozenset("comment comments commentlist disqus replies responses".split())
NAMES = ADVERTS | COMMENTS | frozenset("banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead alert popup modal overlay subscribe signup login share sharing social related recommended pagination pager skip widget widgets toolbar".split())
OUTSIDE = frozenset("header topbar".split())
LAYOUT = frozenset("area article articles bar block body bottom box button buttons buttons card cards column container content count entry footer global group header inner item items js left link links list main outer page panel policy post posts primary right row secondary section site slot stories story text thread top unit wrap wrapper".split())
#: Words that name whose comments they are, or in what form.
WHOSE = frozenset("user users reader readers visitor visitors public guest guests feed stream tree threads reply discussion new all view".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
WORD = re.compile("[a-z]+")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

#: How much more a character inside an article or main element weighs.
BONUS = 3.0


def boilerplate_name(name: str, listed: frozenset[str]) -> bool:
    """A name that has a listed word, and besides only words of layout: comment-list, but not related-work or has-sidebar."""
    words = WORD.findall(name.lower())
    return any(w in listed for w in words) and all(w in listed or w in LAYOUT or len(w) == 1 for w in words)


def comments_name(name: str) -> bool:
    """A name of reader comments, theirs or in a form of list: user-comments, comment-thread, but not comments-open."""
    words = WORD.findall(name.lower())
    return any(w in COMMENTS for w in words) and all(w in COMMENTS or w in LAYOUT or w in WHOSE or len(w) == 1 for w in words)


class Lines(HTMLParser):
    """Events to lines, one per block of text outside of boilerplate elements.

    A line is (text, tags, link characters, node); nodes are the open blocks as a tree:
    ``parent``, ``kind`` (tag), ``named`` (by its class or id boilerplate) and ``said``
    (by these reader comments) by number.
    Every event takes amortised constant time: open elements are found by tag, and
    those closed out of order are struck out where they stand.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int] | None] = []
        self.where: dict[str, list[int]] = {}
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.skipped = 0
        self.parent, self.kind, self.named, self.said, self.inside = [0], ["html"], [False], [False], [False]
        self.node = 0

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self.linked, self.node))
            self.parts = []
        self.tags = self.linked = 0

    def drops(self, tag: str, attrs: dict[str, str | None]) -> bool:
        """Elements that never hold main text, whatever their lines look like."""
        if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
            return True
        if tag == "header":
            return not self.inside[self.node]
        return bool(HIDDEN.search(attrs.get("style") or ""))

    def names(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in ("html", "body", "main", "article"):
            return False
        classes = (attrs.get("class") or "").split()
        if tag in TEXT:
            return any(c.lower() in ADVERTS for c in classes)
        listed = NAMES if self.inside[self.node] else NAMES | OUTSIDE
        return any(boilerplate_name(n, listed) for n in (*classes, attrs.get("id") or ""))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            if self.where.get("p"):
                self.handle_endtag("p")
            while self.open and tag in CLOSES.get(self.open[-1][0], ()):
                self.pop()
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.skipped:
                self.parts.append(" ")
            return
        known = dict(attrs)
        drop = self.drops(tag, known)
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, drop, self.node))
        self.skipped += drop
        if tag in BLOCK or (tag == "span" and not self.skipped and self.names("div", known)):
            if tag not in BLOCK:
                self.flush()
            self.parent.append(self.node)
            self.kind.append(tag)
            self.named.append(self.names(tag if tag in BLOCK else "div", known))
            self.said.append(tag not in ("html", "body", "main") and tag not in TEXT and any(comments_name(n) for n in (*(known.get("class") or "").split(), known.get("id") or "")))
            self.inside.append(self.inside[self.node] or tag in ("article", "main"))
            self.node = len(self.parent) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use", "iframe"):
            self.handle_endtag(tag)

    def pop(self) -> None:
        """Close the last open element."""
        tag, drop, node = self.open.pop()
        self.where[tag].pop()
        if node != self.node:
            self.flush()
            self.node = node
        self.skipped -= drop
        while self.open and self.open[-1] is None:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.where.get(tag):
            if tag in BLOCK:
                self.flush()
            return
        at = self.where[tag][-1]
        if tag not in BLOCK and not self.open[at][1] and at < len(self.open) - 1:
            self.where[tag].pop()  # an inline end does not close the blocks inside it
            self.open[at] = None
            return
        while len(self.open) > at:
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.where.get("a"):
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(ratios: Sequence[float], sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the ends are repeated."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(ratios, float), reach, "edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """The mean of two clusters' means; below all values if they are much alike."""
    lo, hi = float(values.min()), float(values.max())
    if hi <= 2 * lo:
        return -1.0
    for _ in range(32):
        cut = (lo + hi) / 2
        step = float(values[values <= cut].mean()), float(values[values > cut].mean())
        if step == (lo, hi):
            break
        lo, hi = step
    return (lo + hi) / 2


def subtree(weights: np.ndarray, parent: Sequence[int]) -> np.ndarray:
    """For each node the weights of all nodes in and below it; a parent's number is smaller than its children's."""
    out = weights.astype(float).copy()
    for k in range(len(parent) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def below(parent: Sequence[int], start: Sequence[bool]) -> np.ndarray:
    """Nodes that are, or lie in, a start."""
    out = np.array(start, bool)
    for k in range(1, len(parent)):
        out[k] |= out[parent[k]]
    return out


def within(weights: np.ndarray, parent: Sequence[int], blocked: np.ndarray) -> np.ndarray:
    """As ``subtree``, but what lies in a blocked node does not count above it."""
    out = weights.astype(float).copy()
    for k in range(len(parent) - 1, 0, -1):
        if not blocked[k]:
            out[parent[k]] += out[k]
    return out


def boilerplate(page: Lines, weight: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Nodes in blocks that class or id name as boilerplate.

    Reader comments always are, unless a page has nothing else.  Other named blocks stay
    around the page's own article or main element: the one with most text outside of named
    blocks, and rather one outside of them unless that has less than a quarter of the
    most; on pages without such elements, if they hold most of the text.
    """
    parent, of_lines = page.parent, np.bincount(node, weight, len(page.parent))
    said = below(parent, page.said)
    if not of_lines[~said].any():
        said[:] = False
    named = np.array(page.named) & ~said
    own = within(of_lines, parent, named | said)
    marked = np.array([k in ("article", "main") for k in page.kind]) & ~said & (own > 0)
    stays = np.zeros(len(parent), bool)
    if marked.any():
        apart = marked & ~below(parent, named)
        pick = apart if apart.any() and 4 * own[apart].max() >= own[marked].max() else marked
        k = int(np.argmax(np.where(pick, own, -1)))
        while k:
            stays[k], k = True, parent[k]
    else:
        all_of = subtree(of_lines, parent)
        stays = 2 * all_of > all_of[0]
    return said | below(parent, named & ~stays)


def regions(page: Lines, mass: np.ndarray, high: np.ndarray) -> list[int]:
    """The nodes that hold the page's main text: article elements, a main element, or a container.

    A main element counts if it has more than half of the mass, and in it, or in a page
    without one, all outermost articles that hold a line of the upper cluster, if they
    have more than half of it together.  Else the page shrinks to the one container that has all but a
    tenth of the mass, again and again.
    """
    parent, kind = page.parent, page.kind
    main = max((k for k, t in enumerate(kind) if t == "main"), key=lambda k: mass[k], default=0)
    top = main if 2 * mass[main] > mass[0] else 0
    inner = below(parent, np.arange(len(parent)) == top)
    article = np.array([t == "article" for t in kind])
    outer = article & ~below(parent, article)[np.array(parent)] & inner & (high > 0)
    found = np.flatnonzero(outer).tolist()
    if found and 2 * mass[found].sum() > mass[top]:
        return found
    if top:
        return [top]
    children: dict[int, list[int]] = {}
    for k in range(1, len(parent)):
        children.setdefault(parent[k], []).append(k)
    region = 0
    while (best := max(children.get(region, ()), key=lambda k: mass[k], default=None)) is not None and kind[best] not in TEXT and 10 * mass[best] >= 9 * mass[region] > 0:
        region = best
    return [region]


def select(page: Lines, sigma: float = 1.0) -> list[int]:
    """The numbers of the lines of the content regions, in page order.

    Each line's ratio is its characters outside of links by its tags.  Ratios are
    smoothed over neighbouring lines and split in two clusters; the characters of
    the upper cluster are the mass of the blocks that hold them, ``BONUS`` times as
    much in an article or main element.  Boilerplate goes, then the regions with the
    mass are kept: articles and main elements whole; of any other container the lines from the
    first to the last of the upper cluster and the paragraphs, items and headings that
    adjoin them, without items and cells that are mostly links.  Headings right before
    the first region belong to it.
    """
    if not page.lines:
        return []
    parent, kind = page.parent, page.kind
    size = np.array([len(t) for t, *_ in page.lines])
    free = np.maximum(size - np.array([x[2] for x in page.lines]), 0)
    tags = np.array([max(1, x[1]) for x in page.lines])
    node = np.array([x[3] for x in page.lines])
    of_nodes = lambda w: subtree(np.bincount(node, w, len(parent)), parent)
    fine = ~boilerplate(page, free if free.any() else size, node)[node]
    if not fine.any():
        return []
    high = np.zeros(len(size), bool)
    values = smoothed((free / tags)[fine], sigma)
    high[fine] = values > threshold(values)
    marked = np.array(page.inside)
    mass = of_nodes(np.where(high, free, 0) * np.where(marked[node], BONUS, 1.0))
    if not mass[0]:
        mass = of_nodes(np.where(fine, size, 0))
    found = regions(page, mass, of_nodes(high))
    inside = below(parent, np.isin(np.arange(len(parent)), found))[node] & fine
    if kind[found[0]] not in ("article", "main"):
        inside &= (2 * free >= size) | np.array([k == "p" for k in kind])[node]
        at = np.flatnonzero(inside & high)
        if len(at):
            first, last = int(at[0]), int(at[-1])
            prose = inside & np.array([k in TEXT for k in kind])[node]
            while first > 0 and prose[first - 1]:
                first -= 1
            while last + 1 < len(size) and prose[last + 1]:
                last += 1
            inside[:first] = inside[last + 1 :] = False
    kept = np.flatnonzero(inside).tolist()
    while kept and kept[0] > 0 and kind[node[kept[0] - 1]] in HEADINGS and fine[kept[0] - 1]:
        kept.insert(0, kept[0] - 1)
    return kept


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.lines[i][0] for i in select(parser))


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The main text of each page: keep..., text, n_chars.

    Blocks are in page order, one a line; white space inside a block is one space and
    character references are decoded.  Null and empty pages, and pages without a
    content region, give an empty text.  Repeated rows each give a row.  Columns not in
    ``keep`` are not read.  An empty table gives an empty table.
    """
    schema = T.StructType([*(field(pages, c) for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return map_texts(pages.select(*keep, html), run, schema)
