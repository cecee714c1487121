"""Main-text extraction by tag-path ratios.

Every text node has a path of tags from the root.  Text length and punctuation are aggregated per path; their ratios, weighted
by what markup says about a path, are smoothed over neighbouring nodes of the same box, fused, and compared with a
threshold.  The blocks of nodes above it are content.  A box is a labelled div, list, table or the like: it stands or falls
by the ratios of its own paths, within an article too, and goes as a whole if none of its blocks is content.  The content
element is the deepest section that holds nearly all content; short blocks (headings, list items, quotes) of it and of boxes
that hold content belong to the text, except those below the threshold that markup or links set apart.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate

#: Elements that hold no text of the page itself.
DROPPED = frozenset("head title script style noscript template select textarea button input iframe object svg canvas audio video".split())
#: Elements that stand beside the main text, unless they hold an article or main element.
ASIDE = frozenset("nav footer aside form dialog menu header".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside address hr details summary form fieldset".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that can be the content element.
SECTIONS = frozenset("# html body article section main div td form header details".split())
#: Words of a class, id or role that name a part beside the text, and words that may stand with them.
BESIDE = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead comment comments commentlist disqus replies respond cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended trending toolbar pagination pager skip complementary contentinfo search".split()
)
NEUTRAL = frozenset("site page main global top bottom left right bar box block list links link items area section container wrapper inner outer panel widget header reader user form 1 2 3".split())
#: Words of a class, id or role that name a part of the text; an element named so is no box.
TEXTUAL = frozenset("article author body byline caption content date dateline description entry figure headline intro lead lede meta post prose pullquote quote story subtitle summary text title".split())
#: Elements that are boxes if they have a class, id or role.
BOXES = frozenset("div section aside nav ul ol dl table form details header footer menu dialog".split())
#: Beginnings of longer words in BESIDE; other words that begin so are weak evidence.
STEMS = frozenset(w[:6] for w in BESIDE if len(w) >= 6 and w not in ("complementary", "contentinfo"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Weights of paths: below an element named so, below one whose name has such a word among others, and within an article
#: or main element.
NAMED, HINTED, ARTICLE = 0.1, 0.4, 2.0
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PUNCT = re.compile(r"[.,;:!?。，、！？…]")
#: Start tags that end an open element of the second set.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Element:
    __slots__ = ("aside", "box", "depth", "filled", "held", "hinted", "holds", "inside", "linked", "main", "name", "named", "other", "parent", "path", "section", "size", "weight")

    def __init__(self, name, parent, aside=False, labels=()):
        self.name, self.parent, self.aside = name, parent, aside  # aside: None where there is no text
        self.named = bool(labels) and names_aside(labels)
        self.hinted = bool(labels) and not self.named and any(_hints(x) for x in labels)
        self.path = hash((parent and parent.path, name, labels[0] if labels else ""))  # names the path of tags within a page
        self.box = self if labels and name in BOXES and not any(_is_textual(x) for x in labels) else parent and parent.box
        self.filled = False  # of a box: it has content
        self.depth = parent.depth + 1 if parent else 0
        self.main = bool(parent and parent.main) or name in ("article", "main")
        self.linked = bool(parent and parent.linked) or name == "a"
        self.section = self if name in SECTIONS else parent.section
        self.size = self.held = 0.0  # characters of text and of content
        self.other = 0  # text nodes that are neither content nor headings
        self.holds = self.inside = False  # holds: an article or main element with text
        self.weight = 1.0


def names_aside(labels: list[str]) -> bool:
    """True if one of the words of a class, id or role consists of words for parts beside the text."""
    for label in labels:
        parts = [x for x in re.split(r"[-_]+", label.lower()) if x]
        if any(x in BESIDE for x in parts) and all(x in BESIDE or x in NEUTRAL for x in parts):
            return True
    return False


@lru_cache(4096)
def _hints(label: str) -> bool:
    """True if a word of a class, id or role, or a part of one written together, is or begins like one in BESIDE."""
    for part in re.split(r"[-_]+", label.lower()):
        if part in BESIDE or part[:6] in STEMS and len(part) >= 6:
            return True
        if any(part[:i] in BESIDE and part[i:] in NEUTRAL for i in range(2, len(part) - 1)):
            return True
    return False


@lru_cache(4096)
def _is_textual(label: str) -> bool:
    return any(part in TEXTUAL for part in re.split(r"[-_]+", label.lower())) and not _hints(label)


def parse(page: str) -> tuple[list[tuple[_Element, int, str]], list[_Element]]:
    """(text nodes in page order: innermost element, number of the block, decoded text; elements, parents first)."""
    root = _Element("#", None)
    stack, nodes, elements, block, last = [root], [], [root], 0, 0
    opened: Counter[str] = Counter()

    def text(upto):
        raw = page[last:upto]
        if raw and stack[-1].aside is not None:
            nodes.append((stack[-1], block, html_lib.unescape(raw)))

    def close(i):
        opened.subtract(e.name for e in stack[i:])
        del stack[i:]

    for m in _MARK.finditer(page):
        text(m.start())
        last = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attrs = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name in BLOCKS:
            block += 1
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i].name == name:
                    close(i)
                    break
                if name not in BLOCKS and stack[i].name in BLOCKS:
                    break  # an inline end tag does not close a block
            continue
        if name in VOID:
            if name == "br" and stack[-1].aside is not None:
                nodes.append((stack[-1], block, " "))
            continue
        if opened["p"] and name in BLOCKS and name not in ("html", "body"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        if any(opened[x] for x in _ENDS.get(name, ())):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in _ENDS[name]:
                    close(i)
                    break
                if stack[i].name in ("ul", "ol", "dl", "table", "select"):
                    break
        labels = " ".join(x for t in _LABEL.findall(attrs) for x in t if x).split() if attrs else []
        up = stack[-1]
        if up.aside is None or name in DROPPED or attrs and _HIDDEN.search(attrs):
            aside = None  # no text at all
        else:
            aside = name in ASIDE and not (name == "header" and up.main)
        if not (attrs.endswith("/") and name not in BLOCKS):
            stack.append(_Element(name, up, aside, labels))
            elements.append(stack[-1])
            opened[name] += 1
    text(len(page))
    return nodes, elements


def _weigh(nodes: list[tuple[_Element, int, str]], elements: list[_Element]) -> None:
    """Sets the elements' weights; 0 stands for an element beside the text.

    An element that holds an article or main element with text stands beside nothing, nor does a form or a named element
    that holds most of the text of a page without one.
    """
    for e, _, t in nodes:
        e.size += len(t.strip())
    for e in reversed(elements[1:]):
        e.parent.size += e.size
        e.parent.holds = e.parent.holds or e.holds or e.name in ("article", "main") and not e.named and e.size > 0
    root = elements[0]
    for e in elements[1:]:
        e.weight = e.parent.weight
        most = not root.holds and e.size > 0.5 * root.size
        if e.aside and not e.holds and not (most and e.name == "form"):
            e.weight = 0.0
        elif e.named and not e.holds and not most:
            e.weight = min(e.weight, NAMED)
        elif e.hinted and not e.holds and not most:
            e.weight = min(e.weight, 1.0) * HINTED if e.parent.weight >= 1 else e.weight
        elif e.name in ("article", "main") and e.weight == 1.0:
            e.weight = ARTICLE


def path_scores(paths: list, lengths: np.ndarray, marks: np.ndarray, weights: np.ndarray, boxes: list | None = None, sigma: float = 1.0) -> np.ndarray:
    """Fused ratio per node: text and punctuation per node of its path, weighted, smoothed over neighbours, multiplied.

    With boxes (a number for each node) a node's neighbours are the nodes before and after it in its own box.
    """
    names, of = np.unique(np.array(paths, np.int64), return_inverse=True)
    each = np.maximum(np.bincount(of, minlength=len(names)), 1)
    text = weights * (np.bincount(of, weights=lengths, minlength=len(names)) / each)[of]
    punct = weights * (np.bincount(of, weights=marks, minlength=len(names)) / each)[of]
    near = np.exp(-(np.arange(-2, 3) ** 2) / (2 * sigma**2))
    order = np.argsort(np.zeros(len(paths)) if boxes is None else boxes, kind="stable")
    edges = np.flatnonzero(np.diff(np.asarray(boxes)[order])) + 1 if boxes is not None else []

    def smooth(x):
        # Two blanks between boxes keep their nodes apart.
        places = np.arange(len(x)) + 2 * np.searchsorted(edges, np.arange(len(x)), "right")
        line = np.zeros(places[-1] + 1)
        line[places] = x[order]
        out = np.empty(len(x))
        out[order] = np.convolve(line, near / near.sum(), mode="full")[2 : 2 + len(line)][places]
        return out

    return weights * np.sqrt((smooth(text) + text) / 2) * (1 + np.sqrt((smooth(punct) + punct) / 2))


def extract(page: str | None, share: float = 0.25) -> str:
    """The main text: blocks joined by newlines, white space within a block as one space; '' if there is none."""
    nodes, elements = parse(page or "")
    _weigh(nodes, elements)
    nodes = [n for n in nodes if n[0].weight]
    filled = [(e, b, t) for e, b, t in nodes if not t.isspace()]
    if not filled:
        return ""
    lengths = np.array([len(t.strip()) for _, _, t in filled], float)
    marks = np.array([len(_PUNCT.findall(t)) for _, _, t in filled], float)
    weights = np.array([e.weight * (0.5 if e.linked else 1.0) for e, _, _ in filled])
    boxes: dict[int, int] = {}
    in_box = [boxes.setdefault(id(e.box), len(boxes)) for e, _, _ in filled]
    scores = path_scores([e.path for e, _, _ in filled], lengths, marks, weights, in_box)
    on = scores >= share * scores.max()
    content = {b for (_, b, _), x in zip(filled, on, strict=True) if x}
    # The deepest section that holds nearly all the content.
    for (e, _, _), size, x in zip(filled, lengths, on, strict=True):
        e.section.held += size * x
        if x and e.box:
            e.box.filled = True
    for e in reversed(elements[1:]):
        e.parent.held += e.held
        if e.filled and e.parent.box:
            e.parent.box.filled = True  # a box around a box with content
    best = max((e for e in elements if e.name in SECTIONS and e.held >= 0.9 * elements[0].held), key=lambda e: e.depth)
    while best.main and best.name not in ("article", "main"):
        best = best.parent

    # Headings with nothing else beside the content element belong to the text.
    for (e, b, _), x in zip(filled, on, strict=True):
        e.other += e.weight < 1 or not (x or b in content or e.name in HEADINGS)
    for e in reversed(elements[1:]):
        e.parent.other += e.other
    while not best.main and best.parent is not None and best.parent.other == best.other:
        best = best.parent
    for e in elements:
        e.inside = e is best or e.parent is not None and e.parent.inside
    whole = best.main or best.name not in ("#", "html", "body")
    size, linked, lowest, boxed = Counter(), Counter(), {}, {}
    for (e, b, _), n in zip(filled, lengths.tolist(), strict=True):
        boxed[b] = boxed.get(b, False) or e.inside and e is not best and e.box is not None and e.box.inside and e.box is not best and not e.box.filled
        size[b] += n
        linked[b] += n * e.linked
        lowest[b] = max(lowest.get(b, (0.0, False)), (e.weight, e.name in HEADINGS))
    first, last = min(content), max(content)

    def apart(b):
        """Whether a block below the threshold does not belong to the text around it."""
        weight, heading = lowest[b]
        return boxed[b] or weight < 1 or not best.main and linked[b] > 0.5 * size[b] or not whole and not first <= b <= last and not heading

    out = {b for b in size if b not in content and apart(b)}
    parts: dict[int, list[str]] = {}
    for e, b, t in nodes:
        if b not in out and e.inside:
            parts.setdefault(b, []).append(t)
    lines = (" ".join("".join(p).split()) for p in parts.values())
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, keep: list[str], html: str = "html", text_col: str = "text") -> DataFrame:
    """The keep columns of pages with the main text of each page; null and empty pages give ''.

    A page is handled whole in one Arrow pass; nothing is shuffled.  Repeated rows give repeated results, an empty table an
    empty one; other columns are ignored, and text_col must not be in keep.
    """

    def make():
        return lambda texts: [pa.array([extract(t) for t in texts], pa.string())]

    return annotate(pages, html, keep, [(text_col, "string")], make)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), as extract_pages."""
    return extract_pages(pages, ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
