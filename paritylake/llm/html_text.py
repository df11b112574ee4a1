"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is read as a flat run of text blocks, with the words and link density of each block
and of its neighbours, what the enclosing elements say of themselves, and whether the block lies in the
article that the page marks, beside it, or on a page that marks none. A decision tree,
grown on the small labelled table below by Gini impurity, keeps or drops each block.

Null or empty pages give an empty text. Broken markup never fails: an element left open
ends with the page, and a lone "<" is text. Repeated rows are read one by one; columns
other than id, url and html are ignored. Nothing is cut, whatever the length; a page is held whole.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and name parts by role (fixed values of HTML and of common page templates).
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "textarea", "select", "title")
_OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "noscript", "header"}
_MAIN = {"article", "main"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
           "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
           "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "mpadded", "msub", "msup", "msubsup", "munder",
           "mover", "munderover", "semantics"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NOUN = (r"(?:ads?|advert\w*|banner\w*|breadcrumbs?|comments?|consent|cookies?|disqus|foot(?:er)?|head(?:er)?|menu\w*|nav|navbar|navigation|newsletter|"
         r"notice|pag(?:er|ination)|popup|promo\w*|related|reply|replies|share|sharing|side(?:bar)?|skip|social|sponsor\w*|subscribe|toolbar|widget)")
# One whole name: such a noun, what place it has on the page, and what kind of box it is; not "has-sidebar" or "social-science".
_OUTSIDE_NAME = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|sub|mobile|user|reader|visitor)[_-]+)*"
    r"(?:" + _NOUN + r"|(?:article|blog|entry|post|story)[_-]+(?:ads?|advert\w*|comments?|menu|nav|navigation|newsletter|related|repl(?:y|ies)|share|sharing|side(?:bar)?|sponsor\w*))"
    r"(?:[_-]+(?:" + _NOUN + r"|area|bar|block|box|buttons?|container|content|feed|form|icons?|inner|items?|left|right|top|bottom|links?|list|message|note|outer|panel|posts?|articles?|"
    r"primary|section|slot|space|stream|text|thread|to|unit|wrap|wrapper|zone|\d+))*", re.I)
# Names that inside an article are those of its own head.
_OWN_NAME = re.compile(r"(?:[a-z]+[_-]+)*(?:head|header)(?:[_-].*)?", re.I)
_OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # a script or style left open ends with the page; any other one left open, or a self-closed svg, holds nothing
    r"|<(?P<raw>script|style)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<closed>" + "|".join(n for n in _RAW if n not in ("script", "style", "svg")) + r"|svg(?!(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>))(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</(?P=closed)\s*>"
    r"|</(?P<close>[a-z][a-z0-9:-]*)[^>]*>|<(?P<open>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.I | re.S)
# one attribute after the other, so that no value is taken for a name
_ATTR = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?|\"[^\"]*\"|'[^']*'")
_P_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
           "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    outside: bool
    main: bool
    heading: bool


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, outside, main
    buf: list[str] = []
    links = anchor = 0
    heading = False

    def flush() -> None:
        nonlocal links, buf
        text = " ".join(_html.unescape("".join(buf)).split())
        if text:
            out.append(Block(text, text.count(" ") + 1, links, bool(stack) and stack[-1][1], bool(stack) and stack[-1][2], heading))
        buf, links = [], 0

    for m in _TOKEN.finditer(page or ""):
        if (t := m["text"]) is not None:
            buf.append(t)
            if anchor:
                links += len(t.split())
        elif name := m["open"]:
            name = name.lower()
            if name in _RAW:
                buf.append(" ")
                continue
            if name in _VOID:
                if name not in _INLINE or name == "br":
                    buf.append(" ")
                continue
            if name == "a":
                anchor += 1
            if name in _INLINE:
                continue
            flush()
            if name in _P_ENDS and stack and stack[-1][0] == "p":
                stack.pop()
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
            up = stack[-1] if stack else ("", False, False)
            main = up[2] or name in _MAIN
            # a header inside the article holds its title; one outside is the page's
            outside = up[1] or (name in _OUTSIDE and not (name == "header" and up[2])) or (bool(m["attrs"]) and name not in ("html", "body") and _is_outside(m["attrs"], name, main))
            if not m["attrs"].rstrip().endswith("/"):
                stack.append((name, outside, main))
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif name := m["close"]:
            name = name.lower()
            if name == "a":
                anchor = max(0, anchor - 1)
            if name in _INLINE:
                continue
            flush()
            heading = False
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
                anchor = 0 if name in _P_ENDS else anchor
        else:
            if m["raw"] or m["closed"]:
                buf.append(" ")
    flush()
    return out


def _is_outside(attrs: str, name: str, main: bool) -> bool:
    """What an element says of itself. Names of an article itself, and of its headings, say nothing."""
    named = not (main and (name in _MAIN or name in ("h1", "h2", "h3", "h4", "h5", "h6")))
    for m in _ATTR.finditer(attrs):
        key, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "")
        if key in ("class", "id") and named and any(_OUTSIDE_NAME.fullmatch(v) and not (main and _OWN_NAME.fullmatch(v)) for v in value.split()):
            return True
        if key == "role" and value.lower() in _OUTSIDE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


#: place: 0 on a page that marks no article, 1 within the article, 2 beside it.
FEATURES = ("words", "link_density", "prev_words", "prev_links", "next_words", "next_links", "outside", "place", "heading")
# The labelled table (fixed values): FEATURES of a block, then 1 for main text.
LABELLED = (
    # paragraphs of articles, long and short, first and last, with a link or two
    (48, 0.0, 52, 0.0, 61, 0.0, 0, 1, 0, 1), (120, 0.0, 9, 0.0, 80, 0.0, 0, 1, 0, 1), (33, 0.06, 40, 0.0, 25, 0.0, 0, 1, 0, 1), (3, 0.0, 60, 0.0, 45, 0.0, 0, 1, 0, 1),
    (1, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0, 1), (9, 0.0, 6, 0.0, 120, 0.0, 0, 1, 1, 1), (7, 0.0, 0, 0.0, 35, 0.0, 0, 1, 1, 1), (4, 0.0, 8, 1.0, 2, 0.0, 0, 1, 1, 1),
    (2, 0.0, 2, 0.0, 10, 1.0, 0, 1, 0, 1), (65, 0.2, 70, 0.0, 12, 0.0, 0, 1, 0, 1), (12, 0.33, 44, 0.0, 51, 0.1, 0, 1, 0, 1), (700, 0.0, 8, 0.0, 9, 0.0, 0, 1, 0, 1),
    (3, 0.0, 5, 1.0, 4, 0.0, 0, 1, 1, 1), (6, 0.0, 1, 1.0, 7, 0.0, 0, 1, 1, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 1), (5, 0.0, 2, 0.0, 1, 0.0, 0, 1, 0, 1),
    (4, 0.0, 7, 0.0, 3, 0.0, 0, 1, 1, 1), (1, 0.0, 4, 0.0, 6, 0.0, 0, 1, 1, 1), (7, 0.0, 6, 1.0, 5, 0.0, 0, 1, 0, 1), (8, 0.0, 3, 0.0, 4, 0.2, 0, 1, 0, 1),
    # the article beside links: last paragraphs before a footer, headings after a menu, short and linked paragraphs, linked headings
    (22, 0.0, 40, 0.0, 1, 1.0, 0, 1, 0, 1), (12, 0.0, 40, 0.0, 1, 1.0, 0, 1, 0, 1), (3, 0.0, 50, 0.0, 7, 1.0, 0, 1, 0, 1), (15, 0.0, 30, 0.0, 3, 0.5, 0, 1, 0, 1),
    (5, 0.0, 4, 1.0, 60, 0.0, 0, 1, 1, 1), (5, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0, 1), (5, 0.0, 6, 1.0, 2, 0.0, 0, 1, 0, 1), (5, 0.0, 3, 1.0, 5, 1.0, 0, 1, 1, 1),
    (4, 0.0, 9, 0.0, 4, 1.0, 0, 1, 1, 1), (2, 0.0, 1, 1.0, 3, 1.0, 0, 1, 0, 1), (8, 0.5, 4, 0.0, 3, 1.0, 0, 1, 0, 1), (20, 0.6, 40, 0.0, 30, 0.0, 0, 1, 0, 1),
    (14, 0.8, 9, 0.9, 11, 0.9, 0, 1, 0, 1), (25, 0.7, 6, 0.8, 14, 0.9, 0, 1, 0, 1), (10, 0.9, 50, 0.0, 0, 0.0, 0, 1, 0, 1), (30, 0.95, 20, 0.0, 40, 0.0, 0, 1, 0, 1),
    (16, 0.9, 90, 0.0, 5, 1.0, 0, 1, 0, 1), (30, 0.95, 100, 0.0, 4, 1.0, 0, 1, 0, 1), (12, 0.5, 2, 1.0, 3, 1.0, 0, 1, 0, 1), (7, 0.45, 12, 1.0, 9, 1.0, 0, 1, 0, 1),
    (6, 1.0, 1, 1.0, 50, 0.0, 0, 1, 1, 1), (4, 1.0, 30, 0.0, 5, 1.0, 0, 1, 1, 1), (9, 1.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (3, 1.0, 70, 0.0, 20, 0.0, 0, 1, 1, 1),
    # text of pages without an article element
    (55, 0.0, 47, 0.0, 38, 0.0, 0, 0, 0, 1), (90, 0.05, 6, 0.0, 70, 0.0, 0, 0, 0, 1), (28, 0.0, 30, 0.1, 33, 0.0, 0, 0, 0, 1), (18, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1),
    (8, 0.0, 3, 1.0, 75, 0.0, 0, 0, 1, 1), (6, 0.0, 50, 0.0, 44, 0.0, 0, 0, 1, 1), (15, 0.0, 22, 0.0, 18, 0.0, 0, 0, 0, 1), (5, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1),
    (23, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 1), (25, 0.0, 30, 0.0, 6, 1.0, 0, 0, 0, 1), (33, 0.0, 8, 1.0, 5, 0.9, 0, 0, 0, 1), (10, 0.0, 30, 0.0, 20, 1.0, 0, 0, 0, 1),
    (4, 0.0, 3, 1.0, 75, 0.0, 0, 0, 0, 1), (1, 0.0, 6, 1.0, 9, 0.0, 0, 0, 1, 1), (3, 0.0, 6, 1.0, 2, 0.0, 0, 0, 0, 1), (4, 0.0, 6, 1.0, 8, 1.0, 0, 0, 0, 1),
    (3, 0.0, 30, 0.0, 5, 0.0, 0, 0, 0, 1), (2, 0.0, 8, 0.0, 3, 0.0, 0, 0, 0, 1), (4, 0.0, 12, 0.0, 6, 0.3, 0, 0, 0, 1), (1, 0.0, 2, 1.0, 4, 0.0, 0, 0, 0, 1),
    (5, 0.0, 40, 0.0, 6, 0.0, 0, 0, 0, 1), (5, 0.0, 9, 0.5, 3, 0.3, 0, 0, 0, 1), (5, 0.0, 7, 0.0, 8, 1.0, 0, 0, 0, 1), (2, 0.0, 1, 0.0, 8, 0.5, 0, 0, 0, 1),
    (6, 0.33, 0, 0.0, 1, 0.3, 0, 0, 1, 1), (28, 0.4, 30, 0.0, 33, 0.0, 0, 0, 0, 1), (26, 0.25, 30, 1.0, 6, 1.0, 0, 0, 0, 1),
    # pages of one block or little else
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (60, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 1),
    (35, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 1), (50, 0.0, 5, 1.0, 0, 0.0, 0, 0, 0, 1), (42, 0.1, 0, 0.0, 6, 1.0, 0, 0, 0, 1),
    # menus, lists of links, headers, footers, sidebars, adverts, comments that say what they are
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (5, 1.0, 4, 1.0, 3, 1.0, 1, 0, 0, 0), (12, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0, 0), (30, 0.0, 2, 1.0, 20, 0.0, 1, 0, 0, 0),
    (60, 0.0, 30, 0.0, 45, 0.0, 1, 0, 0, 0), (9, 0.1, 50, 0.0, 3, 1.0, 1, 0, 0, 0), (22, 0.0, 90, 0.0, 31, 0.0, 1, 1, 0, 0), (41, 0.0, 25, 0.0, 7, 0.0, 1, 1, 0, 0),
    (4, 1.0, 60, 0.0, 5, 1.0, 1, 1, 0, 0), (3, 0.0, 1, 1.0, 66, 0.0, 1, 1, 1, 0), (150, 0.0, 10, 0.0, 3, 0.0, 1, 0, 0, 0), (2, 0.0, 0, 0.0, 9, 0.0, 1, 0, 1, 0),
    # the same without a telling element: links, stray short blocks
    (6, 1.0, 5, 1.0, 7, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 80, 0.0, 0, 0, 0, 0), (14, 0.8, 9, 0.9, 11, 0.9, 0, 0, 0, 0), (25, 0.7, 6, 0.8, 14, 0.9, 0, 0, 0, 0),
    (3, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0), (2, 0.0, 1, 0.0, 3, 0.5, 0, 0, 0, 0), (5, 0.0, 6, 1.0, 2, 0.0, 0, 0, 0, 0), (8, 0.5, 4, 0.0, 3, 1.0, 0, 0, 0, 0),
    (14, 0.8, 30, 0.0, 40, 0.0, 0, 0, 0, 0), (40, 0.6, 20, 0.0, 30, 0.0, 0, 0, 0, 0),
    # links and lists of links of the article itself
    (6, 1.0, 70, 0.0, 5, 1.0, 0, 1, 0, 1), (9, 1.0, 8, 1.0, 7, 1.0, 0, 1, 0, 1), (4, 1.0, 90, 0.0, 0, 0.0, 0, 1, 0, 1), (3, 1.0, 2, 1.0, 4, 1.0, 0, 1, 0, 1),
    (1, 1.0, 50, 0.0, 1, 1.0, 0, 1, 0, 1), (12, 1.0, 11, 1.0, 10, 1.0, 0, 1, 0, 1), (25, 1.0, 6, 0.0, 14, 1.0, 0, 1, 0, 1), (5, 1.0, 20, 0.0, 30, 0.0, 0, 1, 0, 1),
    # beside the article, whatever it is
    (60, 0.0, 30, 0.0, 45, 0.0, 0, 2, 0, 0), (5, 1.0, 4, 1.0, 3, 1.0, 0, 2, 0, 0), (12, 0.0, 2, 1.0, 30, 0.0, 0, 2, 0, 0), (3, 0.0, 1, 1.0, 66, 0.0, 0, 2, 1, 0),
    (150, 0.0, 10, 0.0, 3, 0.0, 0, 2, 0, 0), (30, 0.2, 90, 0.0, 0, 0.0, 0, 2, 0, 0), (2, 0.0, 0, 0.0, 50, 0.0, 0, 2, 1, 0), (8, 0.0, 2, 0.0, 9, 0.0, 1, 2, 0, 0),
)


def grow(rows: tuple[tuple[float, ...], ...], depth: int = 9):
    """A tree as nested (feature, threshold, left, right); a leaf is 0 or 1."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            cost = impurity(left) + impurity(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, left, right = best
    return f, cut, grow(tuple(left), depth - 1), grow(tuple(right), depth - 1)


def decide(tree, features: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def features(found: list[Block]) -> list[tuple[float, ...]]:
    density = [min(1.0, b.linked / b.words) for b in found]
    marked = any(b.main and not b.outside for b in found)  # the page marks its article, and it has text
    rows = []
    for i, b in enumerate(found):
        p, n = (found[i - 1].words, density[i - 1]) if i else (0, 0.0), (found[i + 1].words, density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        rows.append((b.words, density[i], *p, *n, int(b.outside), (1 if b.main else 2) if marked else 0, int(b.heading)))
    return rows


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return " ".join(b.text for b, f in zip(found, features(found)) if decide(tree, f))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns, text, n_chars (code points)."""
    src = pages.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{html}`").cast("string").alias("__html"))
    tree = grow(LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h, tree) for h in b.column("__html").to_pylist()]
            arrays = [*(b.column(k) for k in keep), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__html")
    return src.mapInArrow(run, f"{head}, text string, n_chars bigint")
