"""A tolerant reading of HTML into flat arrays of tree nodes."""

from __future__ import annotations

import bisect
import html
import re
from dataclasses import dataclass, field

_name = re.compile(r"<(/?)([a-zA-Z][^\s>/]*)")
_sign = re.compile(r"[\"'>]")
_equals = re.compile(r"=\s*$")
_raw_end = re.compile(r"</([a-zA-Z]+)\s*>")
_attribute = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_split = re.compile(r"[^a-z]+")
# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
FOREIGN = frozenset("svg math".split())
#: Parts of formulas and drawings that start no line of text.
PARTS = frozenset(
    "maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none semantics "
    "animate circle clippath defs ellipse filter g image line lineargradient marker mask path pattern polygon polyline radialgradient rect set stop symbol textpath tspan use".split()
)
#: These end with what holds them if their own end tag is missing, whatever is open in them.
LOOSE = FOREIGN | frozenset("iframe select textarea".split())
INLINE = LOOSE | PARTS | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark noscript q s samp small span strike strong sub sup template time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("html body table ul ol dl div article section main aside nav td th form".split())


@dataclass
class Dom:
    """Node i: tag ('#text' for a text), parent (-1 at the top), words of its class, id and role; texts have text and block."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    marks: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)

    def add(self, tag: str, parent: int, marks: tuple[str, ...], text: str, block: int, raw: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.marks.append(marks)
        self.texts.append(text)
        self.blocks.append(block)
        self.raw.append(raw)
        return len(self.tags) - 1


class _Open:
    """The open nodes, and where each kind of them lies, so that end tags are found without a walk."""

    def __init__(self, dom: Dom, root: int):
        self.dom = dom
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}  # depths of the open nodes of a name
        self.blocks: list[int] = [0]  # depths of those that aren't inline
        self.loose: list[int] = []
        self.fences: list[int] = []
        self.foreign = 0

    def push(self, node: int, name: str) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(name, []).append(depth)
        if name not in INLINE:
            self.blocks.append(depth)
        if name in LOOSE:
            self.loose.append(depth)
        if name in FENCES:
            self.fences.append(depth)
        self.foreign += name in FOREIGN

    def close(self, depth: int) -> None:
        """Close the nodes from this depth on."""
        while len(self.nodes) > depth:
            name = self.dom.tags[self.nodes.pop()]
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            if name in LOOSE:
                self.loose.pop()
            if name in FENCES:
                self.fences.pop()
            self.foreign -= name in FOREIGN

    def depth_of(self, names: tuple[str, ...]) -> int:
        return max((d[-1] for n in names if (d := self.at.get(n))), default=0)

    def end(self, name: str) -> None:
        """An end tag: an inline one doesn't end a block, unless all of that lies in an element that ends with its parent."""
        depth = self.depth_of((name,))
        if depth and name in INLINE:
            block = self.blocks[-1]
            while block > depth:
                out = bisect.bisect_left(self.loose, block) - 1
                if out < 0 or self.loose[out] < depth:
                    return
                block = self.blocks[bisect.bisect_left(self.blocks, self.loose[out]) - 1]
        if depth:
            self.close(depth)


class _Tags:
    """Finds tags from left to right; no stretch of the page is read more than a few times."""

    def __init__(self, page: str):
        self.page = page
        self.none_from: dict[str, int] = {}  # from where on a text isn't found any more

    def find(self, what: str, start: int) -> int:
        if start >= self.none_from.get(what, len(self.page) + 1):
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.none_from[what] = start
        return at

    def end_of(self, start: int) -> int:
        """Where the tag whose name ends before ``start`` ends. A quoted value holds any sign; one whose quote isn't closed ends at the next >.

        A closing quote right after = opens another value: the one before was never closed.
        """
        page, at = self.page, start
        while m := _sign.search(page, at):
            at = m.end()
            if m.group() == ">":
                return at
            if _equals.search(page, max(start, at - 8), at - 1):
                close = self.find(m.group(), at)
                if close < 0 or (close > at and page[close - 1] == "="):
                    end = self.find(">", at)
                    return len(page) if end < 0 else end + 1
                at = close + 1
        return len(page)

    def end_of_raw(self, name: str, start: int) -> int:
        """Where the element whose inside is no HTML ends."""
        at = start
        while (at := self.find("</", at)) >= 0:
            m = _raw_end.match(self.page, at)
            if m and m.group(1).lower() == name:
                return m.end()
            at += 2
        return len(self.page)


def parse(page: str | None) -> Dom:
    """Comments, declarations and the insides of scripts and styles are left out.

    Missing end tags are supplied where the next tag implies them; stray end tags are passed
    over. Text nodes of one block (no block-level tag or line break between them) share a
    block number. A null page is empty. The work grows with the page's length, however broken its tags.
    """
    page = page or ""
    dom = Dom()
    open_nodes = _Open(dom, dom.add("#root", -1, (), "", 0, ""))
    tags = _Tags(page)
    block = at = said = 0
    while True:
        begin = tags.find("<", at)
        kind = page[begin + 1 : begin + 2] if begin >= 0 else ""
        m = _name.match(page, begin) if begin >= 0 and kind not in ("!", "?") else None
        if begin >= 0 and not m and kind not in ("!", "?"):
            at = begin + 1  # a < that starts no tag is text
            continue
        end = begin if begin >= 0 else len(page)
        if end > said:
            dom.add("#text", open_nodes.nodes[-1], (), html.unescape(page[said:end]), block, "")
        if begin < 0:
            return dom
        if not m:
            comment = page.startswith("<!--", begin)
            close = tags.find("-->" if comment else ">", begin + (4 if comment else 1))
            at = said = len(page) if close < 0 else close + (3 if comment else 1)
            continue
        name = m.group(2).lower()
        at = tags.end_of(m.end())
        tag_text = page[begin:at]
        if name not in INLINE:
            block += 1
        if m.group(1):
            open_nodes.end(name)
            said = at
            continue
        closing = ("p",) if name in CLOSES_P else SAME_LEVEL.get(name)
        if closing:
            depth = open_nodes.depth_of(closing)
            if depth and depth >= (open_nodes.fences[-1] if open_nodes.fences else 0):
                open_nodes.close(depth)
        marks: tuple[str, ...] = ()
        if "=" in tag_text:
            found = [next((g for g in a[1:] if g), "") for a in _attribute.findall(tag_text)]
            marks = tuple(w for w in _split.split(" ".join(found).lower()) if w)
        node = dom.add(name, open_nodes.nodes[-1], marks, "", 0, tag_text)
        closed = tag_text.endswith("/>")
        if name in RAW and not (closed and open_nodes.foreign):
            at = tags.end_of_raw(name, at)
        elif name not in VOID and not closed:
            open_nodes.push(node, name)
        said = at
