"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a list of text blocks. A block is described by its words and link density, those of the
blocks before and after it, and what the elements around it say; a decision tree trained on a small
labelled table (``html_examples``) says which blocks are main text, and nothing overrides it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.html_examples import PAGES, variants

#: HTML elements by what they mean for blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no text up to their end tag, and those whose contents aren't shown.
RAW, UNSEEN = frozenset("script style textarea title".split()), frozenset("noscript template svg iframe object select canvas audio video".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Words in class, id or role that mark what isn't main text; of these, the ones whose articles aren't the page's; words
#: that may stand beside them in a name; and words before them in a name that only says what a page has or lacks.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup comment comments disqus reply replies respond share sharing social "
    "related recommended widget toolbar pagination pager login search contentinfo complementary".split()
)
FIRM = frozenset("comment comments disqus reply replies respond related recommended nav navbar navigation menu footer contentinfo".split())
BESIDE = frozenset(
    "area articles bar block body bottom box button buttons col column container content form global group head header icon icons info inner input item items left link links list main "
    "module outer panel post posts primary right row secondary section site slot small text thread title top unit widgets wrap wrapper".split()
)
SAYS = frozenset("has no with without not is hide show enable disable js".split())
TOP = frozenset("header masthead topbar".split())
TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""")
HEAD_END = re.compile(r"</head\s*>|<body[\s>]|<article[\s>]|<main[\s>]", re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "apart", "marked")


class Tree:
    """A binary classification tree by Gini impurity, grown on a table whose last column is the label.

    Depth and least rows a leaf are those with the fewest errors on example layouts left out of the table one at a time.
    """

    def __init__(self, rows: tuple, depth: int = 6, least: int = 6):
        data = np.array(rows, float)
        self.nodes: list[tuple[int, float, int, int, int]] = []  # feature, threshold, left, right, label
        self._grow(data[:, :-1], data[:, -1].astype(int), depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, int(2 * y.sum() >= len(y))))
        if depth == 0 or y.min() == y.max():
            return at
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= t
                n, m = left.sum(), (~left).sum()
                if min(n, m) >= least:
                    p, q = y[left].mean(), y[~left].mean()
                    score = (n * p * (1 - p) + m * q * (1 - q), f, t)
                    best = min(best or score, score)
        if best is None:
            return at
        left = x[:, best[1]] <= best[2]
        a = self._grow(x[left], y[left], depth - 1, least)
        b = self._grow(x[~left], y[~left], depth - 1, least)
        self.nodes[at] = (best[1], float(best[2]), a, b, self.nodes[at][4])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), bool), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, t, a, b, label = self.nodes[at]
            if f < 0:
                out[rows] = bool(label)
            elif len(rows):
                low = x[rows, f] <= t
                todo += [(a, rows[low]), (b, rows[~low])]
        return out


def _mark(attributes: str, in_article: bool) -> int:
    """What class, id and role say: 0 nothing, 1 not main text, 2 nor are articles in it, 3 not shown.

    A name counts if it is made of MARKS and words that stand beside them ("ad-slot", "comment-list"); "related-work"
    and "search-results" don't, nor does what a page has or lacks ("has-sidebar").
    """
    if "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    found = 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 3
        if name in ("class", "id", "role"):
            for part in value.split():
                words = re.findall(r"[^\W\d_]+", part)
                hit = MARKS.intersection(words) or (not in_article and TOP.intersection(words))
                if hit and words[0] not in SAYS and all(w in MARKS or w in BESIDE or w in TOP for w in words):
                    found = max(found, 2 if FIRM.intersection(words) else 1)
    return found


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Text blocks in page order: text, words, words in links, whether in an article or main element, whether marked as
    something else than main text.

    An unclosed element ends with its parent, and one whose contents aren't shown hides nothing if it is never closed. An
    article takes off the marks of what stands around it, but those of comments, related pages and the like. Comments and
    broken tags don't break a block. Linear in the page.
    """
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, int, bool, bool, int]] = []  # element, mark, article, unseen; marks before an article that took them off
    opened: dict[str, int] = {}
    last_end: dict[str, int] = {}
    article = marks = firm = unseen = links = 0
    text: list[str] = []
    linked: list[str] = []
    lower = page.lower()

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                out.append((" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), article > 0, marks > 0))
            text.clear()
            linked.clear()

    def add(part: str) -> None:
        if part and not unseen:
            text.append(part)
            if links:
                linked.append(part)

    def pop() -> str:
        nonlocal article, marks, firm, unseen
        name, mark, a, hidden, taken = stack.pop()
        opened[name] -= 1
        unseen -= hidden
        marks += taken - (mark in (1, 2))
        firm -= mark == 2
        article -= a
        return name

    def closes(name: str, at: int) -> bool:
        """Whether the element has an end tag after this place."""
        if name not in last_end:
            last_end[name] = lower.rfind("</" + name)
        return last_end[name] >= at

    at, n, cdata, headed = 0, len(page), True, True
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            elif m[0] == "<![CDATA[":
                end = page.find("]]>", at) if cdata else -1
                cdata = end >= 0
                if cdata:
                    add(html.escape(page[at:end]))
                    at = end + 3
            else:
                end = page.find(">", at)
                if end < 0:  # nor is there a tag after it
                    add(page[m.start() :])
                    break
                at = end + 1
            continue
        name = name.lower()
        if name == "br" or name == "hr":
            add(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        mark = 0 if closing or not attributes else _mark(attributes, article > 0)
        if name in INLINE and not mark and (not closing or not opened.get(name)):
            continue
        own_end = attributes.rstrip().endswith("/")
        if name == "head" and not closing:
            end = HEAD_END.search(page, at) if headed else None
            headed = end is not None
            if end:
                at = end.end() if end[0][1] == "/" else end.start()
            continue
        if name in RAW and not closing:
            if not own_end and (closes(name, at) or name in ("script", "style")):
                end = lower.find("</" + name, at)
                shut = page.find(">", end) if end >= 0 else -1
                at = n if shut < 0 else shut + 1
            continue
        flush()
        links = 0
        if closing:
            if opened.get(name):
                while pop() != name:
                    pass
        elif name not in VOID and not own_end:
            if name == "p":
                while stack and stack[-1][0] == "p":
                    pop()
            hidden = (name in UNSEEN or mark == 3) and closes(name, at)
            a = name in ("article", "main") or "main" in re.findall(r"role\s*=\s*[\"']?(\w+)", attributes)
            if name in OUTSIDE or name == "header" and not article:
                mark = 2 if name != "header" else max(mark, 1)
            mark = 0 if mark == 3 or name in ("html", "body") or a and mark < 2 else mark
            taken = 0
            if a and not mark and not firm:
                taken, marks = marks, 0
            stack.append((name, mark, bool(a), bool(hidden), taken))
            opened[name] = opened.get(name, 0) + 1
            unseen += bool(hidden)
            marks += mark in (1, 2)
            firm += mark == 2
            article += bool(a)
    flush()
    return out


def block_features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    """A row of FEATURES per block.

    ``apart``: the page has an article and the block isn't in it. An article with less than a quarter of the page's
    unmarked words outside of links isn't the page's article.
    """
    words = np.array([b[1] for b in found], float)
    linked = np.array([b[2] for b in found], float)
    density = linked / np.maximum(words, 1)
    inside, marked = np.array([b[3] for b in found], bool), np.array([b[4] for b in found], bool)
    plain = (words - linked) * ~marked
    inside &= bool(4 * plain[inside].sum() >= plain.sum())
    apart = ~inside & bool(inside.any())
    shift = lambda a, k: np.concatenate([[0.0], a[:-1]]) if k < 0 else np.concatenate([a[1:], [0.0]])
    return np.column_stack([words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), inside, apart, marked]).astype(float)


def labelled() -> tuple[tuple[float, ...], ...]:
    """The labelled table: the blocks of the example pages, their features and then whether they are main text."""
    rows = []
    for name in sorted(PAGES):
        for page, labels, weight in variants(name):
            found = blocks(page)
            assert len(found) == len(labels), name
            rows += [(*f, float(y)) for f, y in zip(block_features(found).tolist(), labels)] * weight
    return tuple(rows)


def main_text(page: str, tree: Tree) -> str:
    """The blocks that the tree takes for main text, joined by a blank."""
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(block_features(found))
    return " ".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, table: tuple | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every whole page. Narrow: no shuffle.

    The tree is grown on ``table`` (rows of FEATURES and a label; the example pages' blocks if not given). Null pages are empty
    and give an empty text; repeated rows stay; other columns are ignored. Very long and very deep pages take
    time in proportion to their length.
    """
    tree = Tree(table or labelled())

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([main_text(p, tree) for p in s.fillna("")], dtype=object)

    out = pages.select("page_id", "url", run(F.col("html").cast("string")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
