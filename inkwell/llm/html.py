"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the log odds that it is
content, given where it stands; a tag scores negative; all weights come from
labelled pages. One linear scan finds the contiguous stretch with the greatest
sum, which is the article but for the parts within it that the markup names as
something else (an advert, a form).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .html_pages import labelled_pages

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>script|style|title|textarea)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
#: Elements whose inside is not shown; one that is never closed hides nothing.
EMBEDDED = frozenset("noscript template iframe object svg canvas select audio video map".split())
NAMED = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+[a-z]*")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that close an open element of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Block tags that close an open paragraph.
NOT_IN_P = BLOCKS - {"li", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary"}
#: Elements that an implied end never crosses.
WALLS = frozenset("table ul ol dl div section article main aside nav".split())
CLOSABLE = frozenset(x for names in CLOSES.values() for x in names) | WALLS

#: Words in class, id and role that name a part of a page.
PARTS_OF_PAGE = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc",
    "header": "header masthead topbar banner",
    "footer": "footer contentinfo colophon copyright",
    "aside": "sidebar aside widget widgets related recommended recommendations trending popular complementary rail teaser",
    "form": "form search login signup subscribe newsletter",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted",
    "notice": "cookie cookies consent notice notices alert popup modal dialog gdpr disclaimer overlay paywall",
    "comment": "comment comments disqus reply replies respond discussion feedback",
    "share": "share sharing social follow",
    "content": "content article post entry story articlebody body main text",
}
PART_OF = {w: part for part, words in PARTS_OF_PAGE.items() for w in words.split()}
TAG_PART = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "notice", "article": "content", "main": "content"}
KINDS = ("nav", "header", "footer", "aside", "form", "ad", "notice", "comment", "share", "hidden")
#: A class name with one of these words tells how a page is laid out.
LAYOUT_WORDS = frozenset("has have with without no is on off layout enabled disabled".split())
#: An element that holds this share of the words of its page is the page's frame,
#: whatever part its class names.
FRAME_SHARE = 0.6
MARKS = {"a": "link", **dict.fromkeys(("p", "blockquote", "pre"), "p"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), **dict.fromkeys(("li", "dd", "dt"), "item"), **dict.fromkeys(("td", "th"), "cell")}
FEATURES = ("bias", *KINDS, "content", "link", "linked block", "p", "heading", "item", "cell", "short", "middle", "by links", "apart", "apart from article")
AT = {name: i for i, name in enumerate(FEATURES)}
TAG_GROUPS = ("p", "heading", "list", "table", "block", "inline")
TRAIN_PAGES = 400
#: Words of one piece that count at most.
MOST_WORDS = 20


def _part(name: str, rest: str) -> tuple[str | None, bool]:
    """The part of the page that an element names, if any, and whether its tag
    does."""
    part = TAG_PART.get(name)
    by_tag = part is not None
    if not rest or rest.isspace():
        return part, by_tag
    for m in NAMED.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "hidden", True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "hidden", True
            continue
        if part is not None and part != "content" or name in ("body", "html"):
            continue
        for token in value.split():
            words = [x.lower() for x in PARTS.findall(token)]
            if LAYOUT_WORDS.isdisjoint(words):
                found = [PART_OF[w] for w in words if w in PART_OF]
                told = next((x for x in found if x != "content"), found[0] if found else None)
                if told and (part is None or part == "content" and told != "content"):
                    part, by_tag = told, False
    return part, by_tag


def _tag_group(name: str) -> int:
    if name == "p":
        return 0
    if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return 1
    if name in ("ul", "ol", "li", "dl", "dt", "dd"):
        return 2
    if name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
        return 3
    return 4 if name in BLOCKS else 5


@dataclass
class Piece:
    """A stretch of text, or a tag (no words), and the element it stands in."""

    text: str
    words: int
    block: int
    element: int
    group: int = -1
    at: int = 0


class Page:
    """Text and tags of a page, in order, and what each element is. Reading is
    linear in the page's length, however deep or unclosed its elements."""

    def __init__(self, html: str):
        self.names, self.parents, self.parts = [""], [-1], [(None, False)]
        self.pieces: list[Piece] = []
        self._read(html)
        self._weigh()

    def _read(self, html: str) -> None:
        low = html.lower()
        ends = {name: low.rfind(f"</{name}") for name in EMBEDDED}
        # open elements: name, element, index of the next one below that is closable
        stack: list[tuple[str, int, int]] = [("", 0, -1)]
        opened: dict[str, int] = {}

        block = embedded = 0

        def cut(i: int) -> None:
            nonlocal embedded
            for name, _, _ in stack[i:]:
                opened[name] -= 1
                embedded -= name in EMBEDDED
            del stack[i:]

        for m in TOKEN.finditer(html):
            if (text := m["text"]) is not None:
                text = unescape(text)
                self.pieces.append(Piece(text, len(text.split()), block, stack[-1][1], at=m.start()))
                continue
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            block += name in BLOCKS and not embedded
            self.pieces.append(Piece(" " if name == "br" else "", 0, block, stack[-1][1], _tag_group(name), m.start()))
            if m["end"] or m["end2"]:
                if opened.get(name):
                    cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
                continue
            rest = m["rest"] or m["rest2"] or ""
            if name in VOID:
                continue
            closes = CLOSES.get(name, ()) or (("p",) if name in NOT_IN_P else ())
            if any(opened.get(x) for x in closes):
                i = len(stack) - 1
                if stack[i][0] not in CLOSABLE:
                    i = stack[i][2]
                while i > 0:
                    if stack[i][0] in closes:
                        cut(i)
                        break
                    i = -1 if stack[i][0] in WALLS else stack[i][2]
            if name in EMBEDDED:
                if ends[name] < m.start():
                    continue
                part = ("hidden", True)
            else:
                part = _part(name, rest)
            self.names.append(name)
            self.parents.append(stack[-1][1])
            self.parts.append(part)
            if not rest.endswith("/"):
                below = len(stack) - 1 if stack[-1][0] in CLOSABLE else stack[-1][2]
                stack.append((name, len(self.names) - 1, below))
                opened[name] = opened.get(name, 0) + 1
                embedded += name in EMBEDDED

    def _weigh(self) -> None:
        """What stands in what, once it is known which elements are frames, and
        which element's own blocks hold the most text."""
        n = len(self.names)
        words, direct = [0] * n, [0] * n
        for x in self.pieces:
            words[x.element] += x.words
        linked = [w if name == "a" else 0 for w, name in zip(words, self.names, strict=True)]
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            words[up] += words[i]
            linked[up] += linked[i] if self.names[i] != "a" else words[i]
            if self.names[i] in BLOCKS and MARKS.get(self.names[i]) in ("p", "heading") or self.names[i] in ("ul", "ol", "table", "dl"):
                direct[up] += max(0, words[i] - 2 * linked[i])
        articles = [i for i in range(n) if self.names[i] in ("article", "main")]
        article = max(articles, key=lambda i: (words[i] - linked[i], i), default=0)
        frames, up = {0}, self.parents[article] if article else -1
        while up > 0:
            frames.add(up)
            up = self.parents[up]
        for i in range(1, n):
            if words[i] > FRAME_SHARE * words[0] and self.parts[i][0] != "comment":
                frames.add(i)
        kinds: list[frozenset[str]] = [frozenset()] * n
        for i in range(1, n):
            part, by_tag = self.parts[i]
            inside = kinds[self.parents[i]]
            if i == article and "hidden" not in inside:
                inside = frozenset()  # what stood open before it was left open
            if part == "header" and "content" in inside or part != "hidden" and not by_tag and i in frames:
                part = None if part != "content" else part
            mark = MARKS.get(self.names[i])
            if part or mark:
                inside = inside | ({part, mark} - {None})
            kinds[i] = inside
        self.kinds = kinds
        told = [any(k in kinds[i] for k in KINDS) for i in range(n)]
        best = max((i for i in range(n) if not told[i]), key=lambda i: (direct[i], -i), default=0)
        self.apart = [True] * n
        self.outside = [bool(article)] * n
        for i in range(n):
            up = self.parents[i]
            self.apart[i] = i != best and (up < 0 or self.apart[up])
            self.outside[i] = bool(article) and i != article and (up < 0 or self.outside[up])
        if not direct[best]:
            self.apart = [False] * n

    def told(self, x: Piece) -> bool:
        """Whether a piece stands in a named part that is not the article."""
        return not self.kinds[x.element].isdisjoint(KINDS)

    def features(self) -> np.ndarray:
        """One row for each piece with words: what it stands in, how long and
        how full of links its block and its neighbours are, and whether it
        stands apart from the bulk of the text."""
        total: dict[int, list[int]] = {}
        rows = [x for x in self.pieces if x.words]
        for x in rows:
            t = total.setdefault(x.block, [0, 0])
            t[0] += x.words
            t[1] += x.words * ("link" in self.kinds[x.element])
        blocks = list(total)
        full = [total[b][1] * 2 > total[b][0] for b in blocks]
        near = {b: any(full[max(0, i - 1) : i] + full[i + 1 : i + 2]) for i, b in enumerate(blocks)}
        out = np.zeros((len(rows), len(FEATURES)))
        out[:, 0] = 1
        for i, x in enumerate(rows):
            for kind in self.kinds[x.element]:
                out[i, AT[kind]] = 1
            words, linked = total[x.block]
            out[i, AT["short"]] = words < 5
            out[i, AT["middle"]] = 5 <= words < 15
            out[i, AT["linked block"]] = linked * 2 > words
            out[i, AT["by links"]] = near[x.block]
            out[i, AT["apart"]] = self.apart[x.element]
            out[i, AT["apart from article"]] = self.outside[x.element]
        return out


@dataclass
class Extractor:
    """Log-odds weights of words by feature, scores of tags by group, and the
    share of its score that a word which is not content counts with."""

    word: np.ndarray
    tag: np.ndarray
    damping: float = 1.0

    def text(self, html: str | None) -> str:
        page = Page(html or "")
        return assemble(page, *self.region(page, page.features() @ self.word))

    def region(self, page: Page, odds: np.ndarray) -> tuple[int, int]:
        """Linear scan for the contiguous region of the greatest sum."""
        rest = iter(odds.tolist())
        best, total, start, region = 0.0, 0.0, 0, (0, 0)
        for i, x in enumerate(page.pieces):
            if x.words:
                own = next(rest)
                total += min(x.words, MOST_WORDS) * (own if own > 0 else self.damping * own)
            elif x.group >= 0:
                total += self.tag[x.group]
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, region = total, (start, i + 1)
        return region


def assemble(page: Page, start: int, stop: int) -> str:
    """The text of a region but for the named parts within it."""
    blocks: dict[int, list[str]] = {}
    for x in page.pieces[start:stop]:
        if x.text and not page.told(x):
            blocks.setdefault(x.block, []).append(x.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.5 * w)
    return w


@cache
def trained(pages: int = TRAIN_PAGES) -> Extractor:
    """Weights from ``pages`` labelled pages: a logistic fit for words, the log
    odds of being content for tags (made negative), and those scales of the
    negative scores that get most of the pages exactly right."""
    labelled = labelled_pages(pages)
    xs, ys, ws, tags, ready = [], [], [], np.ones((len(TAG_GROUPS), 2)), []
    for parts in labelled:
        marks = np.repeat([c for _, c in parts], [len(p) for p, _ in parts])
        page = Page("".join(p for p, _ in parts))
        xs.append(page.features())
        ready.append((page, xs[-1], labelled_text(page, marks)))
        for x in page.pieces:
            if x.words:
                ys.append(marks[x.at])
                ws.append(min(x.words, MOST_WORDS))
            elif x.group >= 0:
                tags[x.group, int(marks[x.at])] += 1
    word = _logistic(np.concatenate(xs), np.array(ys, float), np.array(ws, float))
    odds = np.log(tags[:, 1] / tags[:, 0])
    tag = np.minimum(odds - odds.max(), -0.2)
    tries = [Extractor(word, k * tag, d) for k in (3.0, 1.0, 0.3, 0.1) for d in (1.0, 0.5, 0.2)]
    return max(tries, key=lambda e: sum(assemble(p, *e.region(p, x @ word)) == t for p, x, t in ready))


def labelled_text(page: Page, marks: np.ndarray) -> str:
    """The text of the pieces that are marked as content."""
    blocks: dict[int, list[str]] = {}
    for x in page.pieces:
        if x.text and marks[x.at]:
            blocks.setdefault(x.block, []).append(x.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, extractor: Extractor | None = None, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` and ``text``, the main text, of every row of ``pages``.

    Character references are decoded, white space within a block becomes one
    space, blocks are joined by a line feed. A null or empty page, and one
    without content, has an empty text; null keys and repeated rows stay; other
    columns are not read. The model is small and goes to the workers with the
    function.
    """
    prepare(pages.sparkSession)
    model = extractor or trained()
    kept = pages.select(*keys, F.col(html_col).alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([model.text(x.as_py()) for x in batch.column(len(keys))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], texts], [*keys, "text"])

    return kept.mapInArrow(run, schema)
