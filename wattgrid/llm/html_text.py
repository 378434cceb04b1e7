"""Main text of web pages: flat blocks, judged by a decision tree over their neighbourhood.

A page is cut into flat text blocks at every block-level tag. A block is described by its words and
the share of them inside links, by the same of the blocks before and after it, and by what it
stands in; a class that names furniture is one such sign among others, not a verdict. A small tree, grown here from a labelled table of blocks, tells text from furniture.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import text_batches, text_of, without

# Element names by what they mean for text.
DROPPED = ("script", "style", "textarea", "title")
# Left out if closed. The second kind holds no flow content, so it ends where that begins.
MUTED = frozenset("noscript template iframe".split())
ENDED = frozenset("head svg select button".split())
FURNITURE = frozenset("nav aside footer header form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption summary legend option hr pre address".split())
HOLDERS = frozenset("div section ul ol dl table tbody thead tfoot figure blockquote details center body html hgroup search".split()) | FURNITURE | ARTICLE
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that name furniture.
HINTS = re.compile(
    r"(?:^|(?<!has)(?<!with)(?<!no)[\s_-])(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side|widget|comments?|commentlist|"
    r"respond|reply|replies|disqus|discussion|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|toolbar|share|sharing|social|related|"
    r"recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|disclaimer|copyright|legal|pagination|pager|tags|skip|hidden|"
    r"contentinfo|complementary|search|dialog)(?:$|[\s_-])", re.I)
TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(" + "|".join(DROPPED) + r")\b(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*?(?:/>|>.*?(?:</\1\s*>|$))|<!\[CDATA\[|<[!?][^>]*(?:>|$)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|$)", re.S | re.I)  # a quote opens a value only after =
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOAKED = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

Block = tuple[str, int, int, bool, bool, bool, bool]


def _hinted(attributes: str) -> tuple[bool, bool]:
    """Whether a class, id or role names furniture, and whether the element is hidden."""
    if not attributes or attributes.isspace():
        return False, False
    named = " ".join(CAMEL.sub("-", a or b or c) for a, b, c in ATTRIBUTE.findall(attributes))
    return bool(HINTS.search(named)), bool(CLOAKED.search(attributes))


def muted(tags: list[re.Match[str]]) -> dict[int, int]:
    """First and last tag of each outermost element that is left out."""
    found: dict[int, int] = {}
    open_: list[tuple[int, str]] = []
    for k, m in enumerate(tags):
        name = (m[3] or "").lower()
        if name in MUTED or name in ENDED:
            if not m[2]:
                if not m[4].endswith("/"):
                    open_.append((k, name))
            elif any(n == name for _, n in open_):
                while open_:
                    first, n = open_.pop()
                    if n == name:
                        break
                found[first] = k
        elif open_ and (name in LEAVES or name in HOLDERS) and not m[2] and name not in ("legend", "option"):
            while open_ and open_[-1][1] in ENDED:
                first, n = open_.pop()
                if n == "head":
                    found[first] = k - 1
    out: dict[int, int] = {}
    end = -1
    for first in sorted(found):
        if first > end:
            end = out[first] = found[first]
    return out


def blocks_of(page: str) -> list[Block]:
    """(text, words, words in links, in furniture, in an article, a heading, hinted at as furniture) of each block with text."""
    out: list[Block] = []
    held: list[tuple[str, bool, bool]] = []
    linked: list[tuple[str, bool]] = []
    in_link = False
    leaf, leaf_bad, leaf_hint = "", False, False
    bad_depth = hint_depth = article_depth = 0

    def flush() -> None:
        nonlocal linked
        if linked:
            text = " ".join(html.unescape("".join(t for t, _ in linked)).split())
            if text:
                words = text.count(" ") + 1
                inside = sum(len(html.unescape(t).split()) for t, a in linked if a)
                out.append((text, words, min(inside, words), bad_depth > 0 or leaf_bad, article_depth > 0, leaf in ("h1", "h2", "h3", "h4", "h5", "h6"), hint_depth > 0 or leaf_hint))
            linked = []

    at = 0
    tags = list(TAG.finditer(page))
    silent = muted(tags)
    until = -1
    for k, m in enumerate(tags):
        if m.start() > at and k > until:
            linked.append((page[at:m.start()], in_link))
        at = m.end()
        until = silent.get(k, until)
        name = m[3]
        if not name or k <= until:
            continue
        name = name.lower()
        closing = m[2] == "/"
        if name == "a":
            in_link = not closing
        elif name == "br" or name == "wbr":
            linked.append((" " if name == "br" else "", in_link))
        elif name in LEAVES:
            flush()
            in_link = False
            leaf, (leaf_hint, leaf_bad) = ("", (False, False)) if closing else (name, _hinted(m[4]))
        elif name in HOLDERS:
            flush()
            in_link = False
            leaf, leaf_bad, leaf_hint = "", False, False
            if not closing:
                hint, cloaked = (False, False) if name in ("body", "html", "main") else _hinted(m[4])
                bad = name in FURNITURE or cloaked
                held.append((name, bad, hint))
                bad_depth += bad
                hint_depth += hint
                article_depth += name in ARTICLE
            elif any(h[0] == name for h in held):
                while held:
                    gone, bad, hint = held.pop()
                    bad_depth -= bad
                    hint_depth -= hint
                    article_depth -= gone in ARTICLE
                    if gone == name:
                        break
    if at < len(page):
        linked.append((page[at:], in_link))
    flush()
    return out


FEATURES = ("furniture", "in_article", "heading", "page_has_article", "words", "links", "words_before", "links_before", "words_after", "links_after", "hinted", "page_hinted")


def described(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    words = np.array([b[1] for b in blocks], float)
    links = np.array([b[2] for b in blocks], float) / np.maximum(words, 1)
    flags = np.array([b[3:6] for b in blocks], float).reshape(len(blocks), 3)
    hinted = np.array([b[6] for b in blocks], float)
    counted = words * (1 - flags[:, 0])
    share = np.full(len(blocks), (counted * hinted).sum() / max(counted.sum(), 1))  # of the words outside furniture
    has = np.full(len(blocks), float(flags[:, 1].any()))
    edge = lambda x: (np.concatenate([[0.0], x[:-1]]), np.concatenate([x[1:], [0.0]]))
    (wb, wa), (lb, la) = edge(words), edge(links)
    return np.column_stack([flags, has, words, links, wb, lb, wa, la, hinted, share])


# The labelled table: pages as blocks ``words/linked words`` with F in furniture, A in an article, C hinted at as furniture by
# a class, id or role (of a box beside the text, or of a wrapper around it), H heading, and + for main text.
LABELLED = """
F6/6 F12/0 AH8/0+ A40/0+ A3/0+ A120/2+ A1/0+ A60/0+ F9/0
F5/5 F5/5 AH1/0+ A2/0+ A30/0+ F20/3 F9/0
F1/1 F1/1 F1/1 F30/0 AH6/0+ A80/5+ AF15/0 A70/0+ AF40/2 F14/1
AH4/0+ A1/0+ A1/0+ A200/0+ A5/5+ A90/1+ F60/0 F80/0 F30/0
F6/6 20/0 AH8/0+ A50/0+ A50/40+ A30/0+ 25/0 3/3 F9/0
60/0 A60/0+ A2/0+ A300/10+ 90/0 45/1
AH3/0+ A12/0+ A1/1+ A45/45+ A22/0+ 120/0 F120/0
H7/0+ 80/1+ 60/0+ 4/0+ 90/2+ F8/8 F70/0
2/2 2/2 3/3 1/1 H9/0+ 60/0+ 120/3+ 70/0+ 3/3 2/2 4/3
1/1 1/1 2/2 H5/0+ 45/0+ 30/1+ 12/0+ 25/0+ 2/2 2/2 2/2 5/1
4/4 3/3 100/4+ 14/0+ 150/0+ 6/6 5/5
F3/3 H4/0+ 18/0+ 90/0+ H3/0+ 70/1+ 40/0+ F5/0 F100/0
2/2 5/5 4/4 6/6 3/3 2/2
30/28 40/38 25/25 H6/0+ 140/6+ 110/2+ 30/27 20/20
F20/0 F90/0 F8/0 F1/0 F200/4
5/0+ 60/0+ 8/0+
12/0+ 15/0+ 9/0+ 30/0+
H4/0+ 3/0+ 2/0+ 4/0+ 8/0+
1/0+
A1/0+
A4/4+
AF30/0 A30/0+ AF2/0 A2/0+
F5/0 1/0+ 2/0+ F9/9
F6/6 AH10/0+ A400/0+ A2/0+ A900/20+ A1/0+ A5/0+ A4000/0+ A700/0+ F9/0
AH2/0+ A3000/0+ A30/30+ A2500/0+ A10/0+ 500/0 900/10
F4/4 AH5/0+ A250/0+ A260/0+ AF300/0 A270/0+ A8/0+ 40/0 40/0
H6/0+ 500/2+ 900/0+ 3/0+ 1200/0+ F700/0
F5/5 2/0 AH6/0+ A40/0+ A3/0+ 4/0 12/0
6/0 1/0 A80/0+ A9/0+ A2/2+ 15/0
3/0 AH4/0+ A12/0+ A30/28+ 7/0 H2/0 9/0
3/3 2/2 2/0 3/3 H6/0+ 70/0+ 90/2+ 4/0+ 40/0+ 2/2 3/0 2/2
1/1 4/0 2/2 3/3 80/1+ 3/0+ 120/0+ 4/4 5/0 3/3 2/2
2/2 1/0 5/5 H3/0+ 30/0+ 45/2+ 3/3 4/0 3/3
C6/6 C12/0 AH8/0+ A40/0+ A3/0+ A120/2+ A1/0+ A60/0+ C9/0
C5/5 C5/5 AH1/0+ A2/0+ A30/0+ C20/3 C9/0
C1/1 C1/1 C30/0 AH6/0+ A80/5+ AC15/0 A70/0+ AC40/2 C14/1
AH4/0+ A1/0+ A200/0+ A5/5+ A90/1+ C60/0 C80/0 C130/0 C160/0 C90/0
C8/8 H7/0+ 80/1+ 60/0+ 4/0+ 90/2+ C8/8 C70/0
C3/3 H4/0+ 18/0+ 90/0+ H3/0+ 70/1+ 40/0+ C5/0 C100/0 C80/0
H6/0+ 500/2+ 900/0+ 3/0+ 1200/0+ C700/0 C900/0 C400/0
AC30/0 A30/0+ AC2/0 A2/0+ A50/0+
C5/0 C9/9 H8/0+ 40/0+ 30/0+
H4/0+ 12/0+ 13/0+ F5/5
F6/6 ACH8/0+ AC40/0+ AC3/0+ AC120/2+ AC1/0+ AC60/0+ F9/0
ACH1/0+ AC2/0+ AC30/0+ F20/3
ACH6/0+ AC80/5+ AF15/0 AC70/0+ AF40/2
CH7/0+ C80/1+ C60/0+ C4/0+ C90/2+ F8/8
C12/0+ C15/0+ C9/0+ C30/0+
C1/0+ C4/0+
AC1/0+ AC5/0+
"""
#: A split leaves at least so many rows on either side.
LEAST_ROWS = 3


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows, marks = [], []
    for line in LABELLED.strip().splitlines():
        found = [re.fullmatch(r"(A?)(F?)(C?)(H?)(\d+)/(\d+)(\+?)", x) for x in line.split()]
        rows.append(described([("", int(m[5]), int(m[6]), bool(m[2]), bool(m[1]), bool(m[4]), bool(m[3])) for m in found]))
        marks += [bool(m[7]) for m in found]
    return np.vstack(rows), np.array(marks)


def grown(rows: np.ndarray, marks: np.ndarray, depth: int = 8):
    """A tree that splits by Gini impurity until leaves are pure: a leaf's share of text, or (feature, bound, below, above)."""
    share = float(marks.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            above = rows[:, f] >= bound
            if min(above.sum(), (~above).sum()) < LEAST_ROWS:
                continue
            p, q = marks[above].mean(), marks[~above].mean()
            cost = above.sum() * p * (1 - p) + (~above).sum() * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(bound), above)
    if best is None:
        return share
    _, f, bound, above = best
    return f, bound, grown(rows[~above], marks[~above], depth - 1), grown(rows[above], marks[above], depth - 1)


def shares(tree, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    f, bound, below, above = tree
    up = rows[:, f] >= bound
    out = np.empty(len(rows))
    out[up], out[~up] = shares(above, rows[up]), shares(below, rows[~up])
    return out


def block_tree():
    return grown(*labelled_table())


def main_text(page: str | None, tree=None) -> str:
    """The page's text blocks, joined by a blank line; empty for null, empty and text-free pages."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    good = shares(tree if tree is not None else block_tree(), described(blocks)) >= 0.5
    return "\n\n".join(b[0] for b, g in zip(blocks, good) if g)


def extract_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out``; other columns are kept, a former ``out`` is replaced.

    Every page is read whole, on its own; no shuffle. Broken and unclosed markup is read as far as
    it goes: an unclosed script, style, textarea, title or comment hides the rest of the page, no other element does.
    A head ends where flow content begins. Closed noscript, template, iframe, svg, select and button
    elements are left out; math and what object, canvas, audio, video and map hold is text like any other. A header
    element is a header wherever it stands, inside an article too. Null and empty pages have an empty text; repeated rows are pages of their own.
    """
    text_batches(pages)
    tree = block_tree()

    @F.arrow_udf("string")
    def texts(values: pa.Array) -> pa.Array:
        return pa.array([main_text(v.as_py(), tree) for v in values], pa.string())

    body: Column = texts(text_of(page))
    return without(pages, out).withColumn(out, body) if out != page else pages.withColumn(out, body)

