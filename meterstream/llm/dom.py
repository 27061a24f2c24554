"""A small HTML reader: elements in document order, their text pieces, and features of each element."""

from __future__ import annotations

import html
import re

import numpy as np

# Fixed values of HTML: elements without content, with raw or decoded text only, and that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
DECODED = frozenset("title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul dd dt li".split())
#: An element that ends open ones of the second set, up to the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
#: Cells and tables, the end tags that don't reach out of them, and what holds a paragraph back from being ended.
CELLS = ("table", "td", "th")
IN_CELL = frozenset("p div b i a span".split())
HOLDS_P = ("table", "td", "th", "button", "caption")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")


class Page:
    """Elements (tag, parent, depth, attribute tokens) and the events that make up the page: text pieces and block ends."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths = ["#root"], [-1], [0]
        self.words: list[tuple[str, ...]] = [()]
        self.events: list[tuple[int, str | None]] = []  # a text of an element, or None where a block starts or ends
        self._read(source)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        named: list[str] = []
        if "=" in attributes:
            for key, value in _ATTR.findall(attributes):
                if key.lower() in ("class", "id", "role", "itemprop", "aria-label") or key.lower().startswith("data-"):
                    named += _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        if re.search(r"(?i)\bhidden\b|display\s*:\s*none", attributes):
            named.append("hidden")
        self.words.append(tuple(named))
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        tags, events = self.tags, self.events
        places: dict[str, list[int]] = {}  # by tag: where in the stack its open elements are

        def nearest(names) -> int:
            """Where the innermost open element of these is; 0 if there is none."""
            return max((own[-1] for name in names if (own := places.get(name))), default=0)

        def close(depth: int) -> None:
            while len(stack) > depth:
                tag = tags[stack.pop()]
                places[tag].pop()
                if tag in BLOCK:
                    events.append((stack[-1], None))

        while True:
            found = _TAG.search(source, at)
            to = found.start() if found else len(source)
            if to > at:
                events.append((stack[-1], html.unescape(source[at:to])))
            if not found:
                return
            at = found.end()
            ends, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if ends:
                k = nearest((tag,))
                if k and (tag not in IN_CELL or k > nearest(CELLS)):
                    close(k)
                continue
            if tag in ENDS_P and (k := nearest(("p",))) > nearest(HOLDS_P):
                close(k)
            if tag in IMPLIED:
                shut, limits = IMPLIED[tag]
                while (k := nearest(shut)) > nearest(limits):
                    close(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            node = self._open(tag, stack[-1], attributes or "")
            if tag in BLOCK:
                events.append((stack[-1], None))
            if tag == "br":
                events.append((stack[-1], " "))
            if tag in VOID or (attributes or "").endswith("/") and tag in ("svg", "path"):
                continue
            if tag in RAW or tag in DECODED:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                body = source[at : end.start() if end else len(source)]
                at = end.end() if end else len(source)
                events.append((node, html.unescape(body) if tag in DECODED else body))
                if tag in BLOCK:
                    events.append((stack[-1], None))
                continue
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def text(self, kept: np.ndarray) -> str:
        """The text of kept elements: white space within a block becomes one blank, and blocks are joined by two line ends."""
        blocks, parts = [], []
        for node, piece in self.events:
            if piece is None:
                if parts:
                    blocks.append("".join(parts))
                    parts = []
            elif kept[node]:
                parts.append(piece)
        blocks.append("".join(parts))
        clean = (_SPACE.sub(" ", x).strip() for x in blocks)
        return "\n\n".join(x for x in clean if x)


# Parts of class names, ids and roles that tell of page furniture, by kind, and of main text.
FURNITURE = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs tags tag categories".split(),
    "edge": "header footer masthead banner topbar bottom copyright colophon site logo branding hgroup contentinfo".split(),
    "side": "sidebar side aside widget widgets rail related recommended popular trending more latest complementary promo teaser".split(),
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay toast disclaimer banner paywall".split(),
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense dfp taboola outbrain commercial".split(),
    "form": "form search login signup subscribe newsletter contact input register".split(),
    "comment": "comment comments commentlist respond reply replies discussion disqus reader readers reviews feedback".split(),
    "social": "share sharing social follow facebook twitter author byline meta".split(),
}
MAIN = "article content main post entry body story text blog page".split()
KINDS = [*FURNITURE, "main"]
_KIND = {word: [k for k, name in enumerate(KINDS) if word in (FURNITURE.get(name) or MAIN)] for word in {*MAIN, *(w for ws in FURNITURE.values() for w in ws)}}
#: Tags that have features of their own; all others share one.
TAGS = "article main section div p h1 h2 h3 ul ol li a nav header footer aside form table td script style head title noscript template button select figure figcaption blockquote pre span b dl hidden".split()
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
FEATURES = ["tag", "parent_tag", "depth", "chars", "links", "density", "tags_below", "children", "position", "siblings", "same_tag", "before", "after", "marks", "in_article", "in_furniture", "share", *(f"own_{k}" for k in KINDS), *(f"above_{k}" for k in KINDS), "hidden"]


def features(page: Page) -> np.ndarray:
    """One row of ``FEATURES`` for each element: its tag and attribute tokens, those above it, text and link density of its subtree, depth, and its siblings."""
    n = len(page.tags)
    parents = np.array(page.parents)
    tag = np.array([_TAG_NUMBER.get(t, len(TAGS)) for t in page.tags])
    chars, links, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, piece in page.events:
        if piece:
            chars[node] += len(piece)
            marks[node] += piece.count(".") + piece.count(",")
    links[tag == _TAG_NUMBER["a"]] = chars[tag == _TAG_NUMBER["a"]]
    below, children = np.ones(n), np.zeros(n)
    for k in range(n - 1, 0, -1):
        p = parents[k]
        chars[p] += chars[k]
        marks[p] += marks[k]
        links[p] += links[k] if tag[k] != _TAG_NUMBER["a"] else chars[k]
        below[p] += below[k]
    own = np.zeros((n, len(KINDS)))
    hidden = np.zeros(n)
    for k, words in enumerate(page.words):
        for word in words:
            for kind in _KIND.get(word, ()):
                own[k, kind] = 1
            hidden[k] = hidden[k] or word == "hidden"
    above = own.copy()
    in_article, in_furniture = np.zeros(n), np.zeros(n)
    order, same, last, seen = np.zeros(n), np.zeros(n), {}, {}
    furniture = {_TAG_NUMBER[t] for t in ("nav", "header", "footer", "aside", "form", "script", "style", "head", "noscript", "template", "button", "select")}
    main = {_TAG_NUMBER["article"], _TAG_NUMBER["main"]}
    before, after = np.full(n, -1), np.full(n, -1)
    for k in range(1, n):
        p = parents[k]
        above[k] = np.maximum(above[p], own[k]) if own[p].any() or own[k].any() or above[p].any() else above[k]
        in_article[k] = in_article[p] or tag[k] in main
        in_furniture[k] = in_furniture[p] or tag[k] in furniture
        order[k] = children[p]
        children[p] += 1
        if (prev := last.get(p)) is not None:
            before[k], after[prev] = tag[prev], tag[k]
        last[p] = k
        seen[p, tag[k]] = same[k] = seen.get((p, tag[k]), 0) + 1
        hidden[k] = hidden[k] or hidden[p]
    total = max(1.0, chars[0])
    siblings = np.where(parents >= 0, children[parents], 0)
    count = np.array([seen.get((parents[k], tag[k]), 1) for k in range(n)])
    parent_tag = np.where(parents >= 0, tag[parents], -1)
    return np.column_stack([tag, parent_tag, page.depths, chars, links / np.maximum(chars, 1), chars / below, below, children, order, siblings, count, before, after, 100 * marks / np.maximum(chars, 1), in_article, in_furniture, chars / total, own, above, hidden])
