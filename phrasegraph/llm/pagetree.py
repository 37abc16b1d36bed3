"""Pages as nested token streams, and the small regular expressions (wrappers) inferred from them."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Marks of text slots: plain text, and text that is mostly links.
TEXT, LINKS = "#", "@"

#: Elements nested deeper than this only break lines.
DEPTH = 150

# Element names by what they do to a block of text.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base basefont bgsound col embed frame hr img input link meta param source track".split())
#: Their content is no markup: it ends at the end tag only.
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: An open ``p`` ends where one of these begins.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An open element of the first kind ends where one of its list begins in the same parent.
ENDS_ALIKE = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "option": {"option", "optgroup"},
}
#: Ends the search for an open element that an end tag could close.
FENCES = {"table": {"li", "p", "dt", "dd"}, "td": {"li", "p"}, "th": {"li", "p"}}
#: Alike neighbours of these are one repeated group even if their content differs.
ROWS = set("p li dt dd tr td th option blockquote pre h2 h3 h4 h5 h6".split())

#: Elements that never hold the article's text.
JUNK_TAGS = set(
    "nav header footer aside form menu dialog button select option input head script style template noscript iframe object "
    "canvas svg math audio video textarea title noembed noframes xmp datalist fieldset".split()
)
#: Words of a class, id or role that name such parts.
JUNK_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus discussion feedback foot footer gdpr head header login masthead menu "
    "menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popups privacy "
    "promo promos promotion recommended related replies reply respond rss search share sharing sidebar signup skyscraper social "
    "sponsor sponsored sponsors subscribe tagcloud toolbar topbar widget widgets".split()
)
#: Words that name the part around the article.
MAIN_WORDS = set("article articlebody body content entry main post story text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[A-Za-z][^\s/><]*(?:\"[^\"<]*\"|'[^'<]*'|[^>\"'<]|[\"'])*>?|[^<]+|<", re.S
)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/><]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


class Node:
    """One item of a wrapper: a text slot, an element with its content, or a repeated group of items.

    ``many`` and ``optional`` are the ``+`` and ``?`` of the expression. ``chars`` and ``linked`` count the
    code points seen in a slot and those of them inside links; ``texts`` lists a page's texts in it.
    """

    __slots__ = ("label", "children", "many", "optional", "chars", "linked", "texts", "main", "sign")

    def __init__(self, label: str, children: list[Node] | None = None, many: bool = False, optional: bool = False):
        self.label, self.children, self.many, self.optional = label, children if children is not None else [], many, optional
        self.chars = self.linked = 0
        self.texts: list[int] = []
        self.main = False
        self.sign = label

    @property
    def is_text(self) -> bool:
        return self.label in (TEXT, LINKS)

    def seal(self) -> Node:
        """Fix ``sign``, equal for equal expressions."""
        if not self.is_text:
            inside = " ".join(c.sign for c in self.children)
            self.sign = f"{self.label}({inside}){'+' if self.many else ''}{'?' if self.optional else ''}"
        return self

    def slots(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.is_text:
                yield node
            stack.extend(reversed(node.children))

    def packed(self) -> list:
        own = [self.label, int(self.many) + 2 * int(self.optional) + 4 * int(self.main), self.chars, self.linked]
        return [*own, [c.packed() for c in self.children]] if self.children else own

    @staticmethod
    def unpacked(data: list) -> Node:
        children = [Node.unpacked(c) for c in data[4]] if len(data) > 4 else []
        node = Node(data[0], children, bool(data[1] & 1), bool(data[1] & 2))
        node.main, node.chars, node.linked = bool(data[1] & 4), data[2], data[3]
        return node.seal()


def dumps(node: Node) -> str:
    return json.dumps(node.packed(), separators=(",", ":"), ensure_ascii=False)


def loads(text: str) -> Node:
    return Node.unpacked(json.loads(text))


def expression(node: Node) -> str:
    """The wrapper written out, with ``+`` for repeated and ``?`` for optional items."""
    if node.is_text:
        return node.label
    inside = " ".join(expression(c) for c in node.children)
    text = f"({inside})" if node.label.startswith("+") else f"<{node.label}> {inside} </>" if inside else f"<{node.label}/>"
    return text + ("+" if node.many else "") + ("?" if node.optional else "")


def _label(name: str, tag: str) -> str:
    """The element's name with its class, id and role words; digits are left out, they number pages."""
    words = []
    for match in _ATTRIBUTE.finditer(tag):
        kind = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if kind in ("hidden", "aria-hidden"):
            if kind == "hidden" and value.lower() != "false" or value.lower() == "true":
                words.append("!hidden")
        else:
            words += (w.lower() for w in _WORD.findall(value))
    return ".".join([name, *dict.fromkeys(words)])


class _Open:
    __slots__ = ("name", "label", "children")

    def __init__(self, name: str, label: str):
        self.name, self.label, self.children = name, label, []


def parse(page: str) -> tuple[Node, list[str]]:
    """The page's expression, repeats folded, and the texts its slots refer to.

    A text is a stretch between two block tags: inline tags vanish (``br`` is white space), character
    references are decoded, runs of white space become one blank. Comments, scripts and styles leave nothing.
    Missing end tags are supplied, stray ones ignored; an unfinished tag or element ends with the page.
    """
    stack = [_Open("", "")]
    unopened: Counter[str] = Counter()
    texts: list[str] = []
    run: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                slot = Node(LINKS if linked * 2 > len(text) else TEXT)
                slot.chars, slot.linked = len(text), min(linked, len(text))
                slot.texts.append(len(texts))
                texts.append(text)
                stack[-1].children.append(slot)
        run.clear()
        linked = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            done = stack.pop()
            stack[-1].children.append(Node(done.label, folded(done.children)).seal())

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.match(page, at)
        at = match.end()
        token = match[0]
        if token[0] != "<" or len(token) == 1:
            run.append(token)
            if in_link:
                linked += len(token.strip())
            continue
        named = _NAME.match(token)
        if named is None:
            continue
        name = named[2].lower()
        if named[1]:
            if name == "a":
                in_link = 0
            if name in INLINE:
                continue
            if unopened[name]:
                unopened[name] -= 1
                flush()
                continue
            depth = len(stack) - 1
            fences = {f for f, kinds in FENCES.items() if name in kinds}
            while depth and stack[depth].name != name and stack[depth].name not in fences:
                depth -= 1
            if depth and stack[depth].name == name:
                flush()
                close(depth)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 1
            if name == "br":
                run.append(" ")
            continue
        flush()
        in_link = 0
        if name in ENDS_P:
            depth = len(stack) - 1
            while depth and stack[depth].name not in ("p", "table", "td", "th", "button", "object"):
                depth -= 1
            if stack[depth].name == "p":
                close(depth)
        for depth in range(len(stack) - 1, max(0, len(stack) - 4), -1):
            if name in ENDS_ALIKE.get(stack[depth].name, ()):
                close(depth)
                break
            if stack[depth].name in ("ul", "ol", "dl", "table", "select"):
                break
        if name in RAW:
            ending = _RAW_END[name].search(page, at)
            at = ending.end() if ending else end
            continue
        if name in VOID or token.endswith("/>") and name in ("svg", "path"):
            continue
        if len(stack) > DEPTH:
            unopened[name] += 1
        else:
            stack.append(_Open(name, _label(name, token)))
    flush()
    close(1)
    return Node("", folded(stack[0].children)).seal(), texts


def _absorb(node: Node, other: Node) -> None:
    """Add the texts and counts of an equal expression."""
    for mine, its in zip(node.slots(), other.slots()):
        mine.chars += its.chars
        mine.linked += its.linked
        mine.texts += its.texts


def folded(items: list[Node]) -> list[Node]:
    """Neighbouring repeats as repeated groups: first single items, then stretches of growing length."""
    out: list[Node] = []
    for item in items:
        last = out[-1] if out else None
        if last is not None and item.label == last.label:
            if item.is_text or _core(item) == _core(last):
                _absorb(last, item)
            elif item.label.split(".", 1)[0] in ROWS:
                last = out[-1] = merged(last, item)
            else:
                out.append(item)
                continue
            last.many = True
            last.seal()
            continue
        out.append(item)
    length = 2
    while 2 * length <= len(out):
        names = {sign: i for i, sign in enumerate({x.sign for x in out})}
        signs = np.array([names[x.sign] for x in out])
        alike = np.concatenate([[0], np.cumsum(signs[:-length] == signs[length:])])
        starts = np.flatnonzero(alike[length:] - alike[:-length] == length)
        done: list[Node] = []
        at = 0
        for start in starts.tolist():
            if start < at:
                continue
            done += out[at:start]
            body, stop = out[start : start + length], start + length
            while (signs[stop : stop + length].tolist()) == signs[start : start + length].tolist():
                for mine, its in zip(body, out[stop : stop + length]):
                    _absorb(mine, its)
                stop += length
            done.append(Node("+" + "+".join(x.label for x in body), body, many=True).seal())
            at = stop
        if at:
            out = done + out[at:]
        length += 1
    return out


def _core(node: Node) -> str:
    return " ".join(c.sign for c in node.children)


def merged(a: Node, b: Node) -> Node:
    """The least expression of this kind that covers both items of one label."""
    if a.is_text:
        slot = Node(a.label, many=a.many or b.many, optional=a.optional or b.optional)
        slot.chars, slot.linked, slot.texts = a.chars + b.chars, a.linked + b.linked, a.texts + b.texts
        return slot
    if a.sign == b.sign:
        _absorb(a, b)
        return a
    return Node(a.label, aligned(a.children, b.children), a.many or b.many, a.optional or b.optional).seal()


def _grouped(items: list[Node], other: list[Node]) -> list[Node]:
    """Stretches of ``items`` that are one pass of a repeated group in ``other``, as that group."""
    for group in (x for x in other if x.label.startswith("+")):
        labels = [c.label for c in group.children]
        at = 0
        while at + len(labels) <= len(items):
            if [c.label for c in items[at : at + len(labels)]] == labels:
                items = [*items[:at], Node(group.label, items[at : at + len(labels)]).seal(), *items[at + len(labels) :]]
            at += 1
    return items


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """One list that covers both: matched items merge, an item of only one side becomes optional."""
    a, b = _grouped(a, b), _grouped(b, a)
    out: list[Node] = []
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, [x.label for x in a], [x.label for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += (merged(x, y) for x, y in zip(a[a0:a1], b[b0:b1]))
            continue
        for item in [*a[a0:a1], *b[b0:b1]]:
            item.optional = True
            out.append(item.seal())
    return out


def size(node: Node) -> int:
    return 1 + sum(size(c) for c in node.children)


def pruned(node: Node, most: int) -> Node:
    """``node`` without its optional items of least text until it has at most ``most`` items, if that is possible."""
    while size(node) > most:
        best = None
        stack = [node]
        while stack:
            parent = stack.pop()
            for child in parent.children:
                if child.optional:
                    weight = sum(s.chars for s in child.slots())
                    if best is None or weight < best[0]:
                        best = (weight, parent, child)
                stack.append(child)
        if best is None:
            break
        best[1].children.remove(best[2])
    return _resealed(node)


def _resealed(node: Node) -> Node:
    for child in node.children:
        _resealed(child)
    return node.seal()


def _words(node: Node) -> list[str]:
    return node.label.split(".")


def junk(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article by its name or what it is called.

    ``inside`` an article, a header may hold its title, and one word for the head of it does not count.
    """
    name, *words = _words(node)
    if name == "header" and inside:
        return False
    if name in JUNK_TAGS or "!hidden" in words:
        return True
    if name in ("html", "body", "main", "article"):
        return False
    return any(w in JUNK_WORDS and not (inside and w in ("head", "header")) for w in words)


def judge(root: Node) -> Node:
    """Mark ``main`` on the slots of the article.

    The region is every outermost ``article``, else ``main`` (also by role), else the elements named like
    content, else the element that one reaches from the page by going down while a single child holds most of
    the unlinked text. Inside the region all slots count but those of elements that are no part of an article
    and, outside of articles, those made of links.
    """
    regions: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    mass: dict[int, int] = {}

    def weigh(node: Node, inside: bool) -> int:
        name, *words = _words(node)
        if node.is_text:
            total = max(0, node.chars - node.linked)
        elif node.label and not node.label.startswith("+") and junk(node, inside):
            total = 0
        else:
            total = sum(weigh(c, inside or name in ("article", "main")) for c in node.children)
        mass[id(node)] = total
        return total

    def find(node: Node, under: frozenset) -> None:
        name, *words = _words(node)
        if node.label and not node.is_text and not node.label.startswith("+"):
            if junk(node, False):
                return
            kind = None
            if name == "article" or "articlebody" in words:
                kind = "article"
            elif name == "main":
                kind = "main"
            elif name not in ("html", "body") and MAIN_WORDS.intersection(words):
                kind = "named"
            if kind and kind not in under and mass[id(node)]:
                regions[kind].append(node)
                under = under | {kind}
        for child in node.children:
            find(child, under)

    weigh(root, False)
    find(root, frozenset())
    chosen = next((r for r in regions.values() if r), None)
    firm = bool(regions["article"] or regions["main"])
    if chosen is None:
        node = root
        while True:
            heavy = [c for c in node.children if mass[id(c)] * 10 >= 8 * mass[id(node)] > 0 and not c.is_text]
            if not heavy or heavy[0].label.split(".", 1)[0] in ROWS:
                break
            node = heavy[0]
        chosen = [node]

    def take(node: Node, inside: bool) -> None:
        for child in node.children:
            if child.is_text:
                child.main = firm or child.label == TEXT
            elif child.label.startswith("+") or not junk(child, inside):
                take(child, inside)

    for slot in root.slots():
        slot.main = False
    for region in chosen:
        take(region, firm)
    return root


def placed(page: Node, wrapper: Node) -> None:
    """Give the slots of ``page`` the verdicts of the wrapper's slots they fall on.

    ``page`` has been judged alone before; slots without a counterpart keep that verdict.
    """
    if page.is_text:
        page.main = wrapper.main
        return
    a, b = _grouped(page.children, wrapper.children), _grouped(wrapper.children, page.children)
    matcher = SequenceMatcher(None, [x.label for x in a], [x.label for x in b], autojunk=False)
    for x, y, n in matcher.get_matching_blocks():
        for i in range(n):
            placed(a[x + i], b[y + i])
