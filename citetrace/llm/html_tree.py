"""The block tree of a page: one pass over its tags, in time linear in the page."""

from __future__ import annotations

import html as entities
import re

# Fixed values of HTML: element kinds.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSHOWN = frozenset("noscript template svg object canvas math audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSABLE = frozenset("p li dt dd tr td th option".split())
HOLDERS = frozenset("ul ol dl table body div article section main".split())
FOREIGN = frozenset("svg math".split())
POINTS = frozenset("foreignobject desc annotation-xml".split())
LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main aside nav footer header form".split()
)

# Parts of names that authors give to page regions.
GROUPS = (
    ("good", "article post story entry content main body text"),
    ("nav", "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc sitemap skip"),
    ("head", "header masthead logo top topbar brand"),
    ("foot", "footer bottom copyright legal colophon contentinfo imprint"),
    ("side", "sidebar aside side widget rail complementary secondary"),
    ("ad", "ad ads advert advertisement adverts banner promo promotion sponsor sponsored sponsorship adsense dfp"),
    ("talk", "comment comments commentlist reply replies disqus discussion respond responses reaction reactions feedback thread threads"),
    ("note", "cookie cookies consent gdpr notice notices alert alerts popup modal overlay dialog disclaimer warning notification toast paywall"),
    ("more", "related recommended recommendations share sharing social tags tag byline meta author bio more popular trending newsletter subscribe signup login search"),
)
NAME_OF = {word: g for g, (_, words) in enumerate(GROUPS) for word in words.split()}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
CLOSES_RAW = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for tag in RAW}


class Tree:
    """Nodes in page order: parent, kind, groups of names, and for runs their text and share of links."""

    __slots__ = ("groups", "kind", "linked", "parent", "text")

    def __init__(self):
        self.parent: list[int] = []
        self.kind: list[str] = []
        self.groups: list[tuple[int, ...]] = []
        self.text: list[str | None] = []
        self.linked: list[float] = []

    def node(self, parent: int, kind: str, groups: tuple[int, ...] = (), text: str | None = None, linked: float = 0.0) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.groups.append(groups)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def names_of(attributes: str) -> tuple[tuple[int, ...], bool]:
    """Groups of the words in class, id and role; whether the element is hidden."""
    groups, hidden = set(), False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            style = value.replace(" ", "").lower()
            hidden = hidden or "display:none" in style or "visibility:hidden" in style
        elif name in ("class", "id", "role"):
            for word in SPLIT_NAME.split(value):
                g = NAME_OF.get(word.lower())
                if g is not None:
                    groups.add(g)
    return tuple(sorted(groups)), hidden


class _Open:
    """An open element: its block node; whether it hides what it holds, is a link, is a block; of a block, its open inline
    elements by tag, and where the elements stand that a new one may close."""

    __slots__ = ("block", "hides", "inline", "link", "node", "scope", "tag")

    def __init__(self, tag, node, hides, block, scope):
        self.tag, self.node, self.hides, self.block, self.scope = tag, node, hides, block, scope
        self.link = False
        self.inline: dict[str, int] = {}


class _Parser:
    def __init__(self):
        self.tree = Tree()
        self.stack = [_Open("#root", self.tree.node(-1, "body"), False, True, {})]
        self.blocks = [0]  # places of the open blocks in the stack
        self.opened: dict[str, int] = {}
        self.hidden = 0
        self.link: _Open | None = None
        self.parts: list[str] = []
        self.size = self.linked = 0

    def text(self, part: str) -> None:
        if not self.hidden:
            self.parts.append(part)
            self.size += len(part)
            if self.link:
                self.linked += len(part)

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            if "&" in raw:
                raw = entities.unescape(raw)
            text = SPACE.sub(" ", raw).strip()
            if text:
                self.tree.node(self.stack[self.blocks[-1]].node, "#text", (), text, self.linked / max(1, self.size))
        self.parts, self.size, self.linked = [], 0, 0

    def push(self, tag: str, groups: tuple[int, ...], hides: bool, block: bool) -> _Open:
        top = self.stack[self.blocks[-1]]
        node, scope = top.node, top.scope
        if block:
            if not (self.hidden or hides):
                node = self.tree.node(node, tag, groups)
            if tag in HOLDERS:
                scope = {}
            elif tag in CLOSABLE:
                scope = scope | {tag: len(self.stack)}
            self.blocks.append(len(self.stack))
        else:
            top.inline[tag] = top.inline.get(tag, 0) + 1
        e = _Open(tag, node, hides, block, scope)
        self.stack.append(e)
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.hidden += hides
        return e

    def pop(self) -> _Open:
        e = self.stack.pop()
        self.opened[e.tag] -= 1
        self.hidden -= e.hides
        if e is self.link:
            self.link = None
        if e.block:
            self.blocks.pop()
        else:
            self.stack[self.blocks[-1]].inline[e.tag] -= 1
        return e

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        self.flush()
        while len(self.stack) > k:
            self.pop()

    def end(self, tag: str) -> None:
        if tag in INLINE:  # an inline end tag does not close blocks
            if self.stack[self.blocks[-1]].inline.get(tag):
                while self.pop().tag != tag:
                    pass
        elif self.opened.get(tag):
            self.flush()
            while self.pop().tag != tag:
                pass

    def start(self, tag: str, attributes: str) -> None:
        groups, hides = names_of(attributes) if attributes else ((), False)
        if tag in INLINE:
            e = self.push(tag, groups, hides, False)
            if tag == "a":  # links do not nest
                self.link = e
            return
        self.flush()
        closes = ("p",) if tag in ENDS_P else CLOSES_SAME.get(tag, ())
        at = [k for k in map(self.stack[self.blocks[-1]].scope.get, closes) if k is not None]
        if at:
            self.cut(min(at))
        self.push(tag, groups, hides or tag in UNSHOWN, True)


def parse(page: str) -> Tree:
    """The block tree of a page. Unclosed and stray tags are taken as browsers take them, in the main."""
    p = _Parser()
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        cut = m.start() if m else end
        if cut > at:
            p.text(page[at:cut])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("br", "hr"):
            p.text("\n")
        if p.opened.get("svg") or p.opened.get("math"):
            if tag in LEAVES_FOREIGN and not m[1] and not any(p.opened.get(x) for x in POINTS):
                while p.opened.get("svg") or p.opened.get("math"):
                    p.pop()
            elif m[1]:
                p.end(tag)
                continue
            else:
                if not m[3].rstrip().endswith("/"):
                    p.push(tag, (), False, True)
                continue
        if m[1]:
            p.end(tag)
        elif tag in RAW:
            close = CLOSES_RAW[tag].search(page, at)
            at = close.end() if close else end
        elif tag in VOID:
            if tag == "hr":
                p.flush()
        elif tag not in ("html", "head", "body"):
            p.start(tag, m[3])
        elif tag == "body" and m[3] and names_of(m[3])[1]:
            p.hidden += 1
    p.flush()
    return p.tree
