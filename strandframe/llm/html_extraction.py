"""Main text of web pages from flat text blocks and a decision tree (operator 4).

A page becomes a flat list of text blocks. Each block is described by its words and its link density,
those of its neighbours, and where in the page it stands; a decision tree, grown on the small labelled
table of ``labelled_blocks``, says whether it belongs to the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_blocks import PAGES

#: Comments and declarations, or a tag with quoted attribute values; an end of page inside either ends it.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[a-z]+")
BUTTON = re.compile(r"</button\b[^>]*(?:>|\Z)", re.I)
#: Elements whose contents are no text of the page.
DROPPED = frozenset("script style noscript template iframe svg object canvas select option textarea button head title audio video map".split())
#: Those of them whose contents are not markup: only their own end tag ends them.
RAW = frozenset("script style noscript template iframe textarea title annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup mover munder munderover mpadded mphantom mtable mtr mtd".split()
)
#: Elements whose end tags are often left out: they never enclose a region.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6".split()) | INLINE
ASIDE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login menu navbar navigation nav "
    "breadcrumb breadcrumbs sidebar comment comments disqus reply replies respond footer share sharing social related recommended popup modal overlay widget pagination pager masthead toolbar skip".split()
)
#: Words that may stand beside one of NAMES in a class: they say where or how large the element is, not what it is about.
PLACES = frozenset(
    "site page main global top bottom left right upper lower inner outer block box area wrap wrapper container section list bar item items link links button buttons text title header head body "
    "post posts article articles entry blog story primary secondary mobile desktop fixed sticky js the of and for is in on id col column row group panel inline default".split()
)
#: Words of a class after these say what an element holds or lacks, not what it is.
HOLDS = frozenset("no has with without".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "aside", "heading", "item")
Block = tuple[str, float, bool, bool, bool, bool]  # text, link density, in article, in aside, heading, list item


def _names(attributes: str) -> tuple[set[str], str, bool]:
    """Telling words of class and id, the role, and whether the element is hidden.

    A class tells by all of its words: ``cookie-notice`` and ``site-footer`` do, ``social-science`` does not.
    """
    words: set[str] = set()
    role, hidden = "", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = list(takewhile(lambda w: w not in HOLDS, TOKEN.findall(token)))
                if all(w in NAMES or w in PLACES for w in parts):
                    words.update(parts)
        elif name == "role":
            role = value.strip()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return words, role, hidden


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; character references decoded, white space runs made one space."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool, bool, bool, bool]] = []  # name, article, aside, aside by class or role only, dropped
    article = aside = dropped = link = False
    heading = item = own = begun = False  # own: the block's element is marked itself; begun: an article was seen
    depths: dict[str, int] = {}  # how many elements of a name are open: a stray end tag costs no search
    at = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(t.split()) for t, is_link in parts if is_link)
                words = sum(len(t.split()) for t, _ in parts)
                out.append((text, linked / max(words, 1), article, aside or own, heading, item))
            parts = []

    while True:
        m = TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not dropped:
            parts.append((page[at:stop], link))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        ends = bool(m[1])
        if name == "a" and not dropped:
            link = not ends
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                parts.append((" ", link))
            continue
        if not ends and name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            if name != "textarea":
                continue
        if name == "button" and not ends:  # stands within a line, and its label is no text
            close = BUTTON.search(page, at)
            at = close.end() if close else len(page)
            continue
        flush()
        if ends:
            link = False
        if name in LOOSE:
            heading = not ends and name[0] == "h" and name[1:].isdigit()
            item = not ends and name in ("li", "dt", "dd")
            words, role, _ = _names(m[3]) if m[3] and not ends else (set(), "", False)
            own = role in ROLES or not NAMES.isdisjoint(words)
            continue
        heading = item = own = False
        if name in VOID or name in ("html", "body"):
            if name == "body":
                open_, article, aside, dropped = [], False, False, False
                depths.clear()
            continue
        if ends:
            while depths.get(name):  # all that is open inside the element ends with it
                closed = open_.pop()[0]
                depths[closed] -= 1
                if closed == name:
                    break
        elif not m[3].endswith("/"):
            words, role, hidden = _names(m[3]) if m[3] else (set(), "", False)
            was = open_[-1] if open_ else ("", False, False, False, False)
            is_main, is_article = name == "main" or role == "main", name == "article" or role == "article"
            is_aside = name in ASIDE or name == "header" and not was[1]
            # the page's main part or first article is no aside for the class of a wrapper; later articles may be comments
            inside = was[3] and not (is_main or is_article and not begun)
            begun = begun or is_main or is_article
            depths[name] = depths.get(name, 0) + 1
            open_.append((name, was[1] or is_main or is_article, was[2] or is_aside, inside or role in ROLES or not NAMES.isdisjoint(words), was[4] or name in DROPPED or hidden))
        _, article, tagged, named, dropped = open_[-1] if open_ else ("", False, False, False, False)
        aside = tagged or named
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; neighbours beyond the page have no words and no links."""
    own = np.array([[len(b[0].split()), b[1]] for b in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    flags = np.array([b[2:] for b in found], dtype=float).reshape(-1, 4)
    return np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], flags])


class Tree:
    """A binary decision tree by Gini impurity (CART)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.value, self.feature = float(y.mean()), -1
        if depth == 0 or len(y) < 2 * least or self.value in (0.0, 1.0):
            return
        best = (2 * self.value * (1 - self.value) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            cost = 2 * (p * (1 - p) * n + q * (1 - q) * (len(y) - n))
            cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (float(cost[k]), f, float(v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return
        _, self.feature, self.threshold = best
        low = x[:, self.feature] <= self.threshold
        self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value >= 0.5)
        low = x[:, self.feature] <= self.threshold
        return np.where(low, self.low(x), self.high(x))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    x, y = [], []
    for page, kept in PAGES:
        found = blocks(page)
        assert len(found) == len(kept), (len(found), len(kept), [b[0][:30] for b in found])
        x.append(features(found))
        y += kept
    return np.vstack(x), np.array(y, dtype=float)


@lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str) -> str:
    """The article of a page: its blocks joined by two line breaks."""
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b[0] for b, keep in zip(found, tree()(features(found))) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null html counts as empty: an empty text of 0 code points. Whole pages are read, cut-off markup
    included; null ids and urls, repeated rows and extra columns pass. A narrow map without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
