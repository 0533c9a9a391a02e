"""A small repairing HTML tree on the standard parser.

Void elements, raw text in scripts and styles, implied ends of paragraphs, list items, cells and rows,
and re-opening of formatting elements that were left open (at most three alike) in later blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCK = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SPECIAL = BLOCK | frozenset("applet body button caption col colgroup head html iframe marquee object select td template textarea th thead tbody tfoot title tr".split())
_HEADS = frozenset(f"h{k}" for k in range(1, 7))
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody", "thead"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack += reversed(item.children)

    def text(self) -> str:
        return "".join(self.texts())

    def stripped(self) -> str:
        return "".join(t.strip() for t in self.texts())

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def html(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            attrs = "".join(f' {k}="{_escape(v or "", True)}"' for k, v in item.attrs.items())
            out.append(f"<{item.tag}{attrs}>")
            if item.tag in VOID:
                continue
            stack.append(f"</{item.tag}>")
            raw = item.tag in ("script", "style")
            for c in reversed(item.children):
                stack.append(c if isinstance(c, Node) else c if raw else _escape(c))
        return "".join(out)


def _escape(s: str, quote: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&quot;") if quote else s


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.body = Node("body", parent=self.root)
        self.head = Node("head", parent=self.root)
        self.root.children = [self.head, self.body]
        self.stack: list[Node] = [self.root, self.body]
        self.open: list[Node] = []  # formatting elements to re-open
        self.in_head = False

    def _pop_to(self, node: Node) -> None:
        while self.stack[-1] is not node:
            self.stack.pop()
        self.stack.pop()

    def _close_p(self) -> None:
        for node in reversed(self.stack):
            if node.tag == "p":
                self._pop_to(node)
                return
            if node.tag in ("button", "table", "td", "th", "caption", "body", "object"):
                return

    def _reopen(self) -> None:
        live = {id(n) for n in self.stack}
        for k, node in enumerate(self.open):
            if id(node) not in live:
                self.open[k] = self._push(node.tag, dict(node.attrs))

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        self.stack.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        attrs = {k: v if v is not None else "" for k, v in reversed(attrs)}
        if tag in ("html", "body"):
            (self.root if tag == "html" else self.body).attrs |= {k: v for k, v in attrs.items()}
            self.in_head = False
            return
        if tag == "head":
            self.in_head = True
            return
        if self.in_head or (tag in ("title", "meta", "link", "base", "style", "script") and not self.body.children and len(self.stack) == 2):
            if tag in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
                node = Node(tag, attrs, self.head)
                self.head.children.append(node)
                if tag not in VOID:
                    self.stack.append(node)
                return
            self.in_head = False
        if tag in BLOCK:
            self._close_p()
        if tag in _CLOSES:
            for node in reversed(self.stack):
                if node.tag in _CLOSES[tag]:
                    self._pop_to(node)
                    if tag in ("li", "dt", "dd", "option", "td", "th"):
                        break
                    continue
                if node.tag in _FENCE[tag] or node.tag == "body":
                    break
                if node.tag in SPECIAL and node.tag not in ("div", "p", "address", "tbody", "thead", "tfoot"):
                    break
        if tag in _HEADS and self.stack[-1].tag in _HEADS:
            self.stack.pop()
        if tag == "a" and any(n.tag == "a" for n in self.open):
            self.handle_endtag("a")
        if tag not in BLOCK and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot", "script", "style"):
            self._reopen()
        node = self._push(tag, attrs)
        if tag in VOID:
            self.stack.pop()
        elif tag in FORMAT:
            alike = [n for n in self.open if n.tag == tag and n.attrs == attrs]
            if len(alike) >= 3:
                self.open.remove(alike[0])
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_head = False
            return
        if tag in VOID or tag in ("html", "body"):
            if tag == "br":
                self.handle_starttag("br", [])
            return
        if tag == "p" and not any(n.tag == "p" for n in self.stack):
            self._push("p", {})
            self.stack.pop()
            return
        if tag in FORMAT:
            for node in reversed(self.open):
                if node.tag == tag:
                    self.open.remove(node)
                    if any(n is node for n in self.stack):
                        # close it and let the formatting opened inside go on behind it
                        self._pop_to(node)
                    return
            return
        for node in reversed(self.stack[2:]):
            if node.tag == tag:
                self._pop_to(node)
                return
            if node.tag in SPECIAL and tag not in SPECIAL:
                return
            if tag in ("td", "th", "tr", "li", "p") and node.tag in ("table", "body"):
                return

    def handle_data(self, data):
        if self.stack[-1].tag not in ("script", "style", "title", "textarea"):
            if self.in_head:
                if not data.strip():
                    return
                self.in_head = False
            if data.strip():
                self._reopen()
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    """The document's root; never raises on bad markup."""
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except (AssertionError, IndexError):
        pass  # what was read stands
    return b.root


# --- selectors: tag, #id, .class, [a], [a=v], [a~=v], [a^=v], [a$=v], [a*=v], :nth-of-type(n), :first-of-type, descendant, child, comma

_SIMPLE = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]|:nth-of-type\((?P<nth>\d+)\)|:(?P<first>first-of-type)""")


class Selector:
    """A compiled selector of the subset above; raises ValueError on anything else."""

    def __init__(self, css: str):
        self.groups = [self._chain(part) for part in _split_commas(css)]

    @staticmethod
    def _chain(text: str) -> list[tuple[str, list[dict]]]:
        tokens = re.findall(r"""\s*>\s*|(?:\[[^\]]*\]|[^\s>\[])+|\s+""", text.strip())
        chain, link = [], " "
        for t in tokens:
            if not t.strip():
                continue
            if t.strip() == ">":
                link = ">"
                continue
            at, tests = 0, []
            while at < len(t):
                m = _SIMPLE.match(t, at)
                if not m:
                    raise ValueError(f"unsupported selector {text!r}")
                tests.append({k: v for k, v in m.groupdict().items() if v is not None})
                at = m.end()
            chain.append((link, tests))
            link = " "
        if not chain:
            raise ValueError("empty selector")
        return chain

    @staticmethod
    def _fits(node: Node, tests: list[dict]) -> bool:
        for t in tests:
            if "tag" in t and t["tag"] != "*" and node.tag != t["tag"].lower():
                return False
            if "id" in t and node.attrs.get("id") != t["id"]:
                return False
            if "cls" in t and t["cls"] not in node.classes:
                return False
            if "attr" in t:
                have = node.attrs.get(t["attr"].lower())
                if have is None:
                    return False
                if "op" in t:
                    v = t["val"].strip("\"'")
                    op = t["op"]
                    if not (have == v if op == "=" else v in have.split() if op == "~=" else bool(v) and have.startswith(v) if op == "^=" else bool(v) and have.endswith(v) if op == "$=" else bool(v) and v in have if op == "*=" else have == v or have.startswith(v + "-")):
                        return False
            if "nth" in t or "first" in t:
                same = [n for n in node.parent.elements() if n.tag == node.tag] if node.parent else [node]
                if next((k for k, n in enumerate(same, 1) if n is node), 0) != int(t.get("nth", 1)):
                    return False
        return True

    def _matches(self, node: Node, chain: list, k: int) -> bool:
        link, tests = chain[k]
        if not self._fits(node, tests):
            return False
        if k == 0:
            return True
        up = node.parent
        while up is not None:
            if self._matches(up, chain, k - 1):
                return True
            if link == ">":
                return False
            up = up.parent
        return False

    def select(self, root: Node) -> Iterator[Node]:
        return (n for n in root.walk() if any(self._matches(n, c, len(c) - 1) for c in self.groups))

    def first(self, root: Node) -> Node | None:
        return next(self.select(root), None)


def _split_commas(css: str) -> list[str]:
    return [p for p in re.split(r",(?![^\[]*\])", css) if p.strip()] or [""]


def select_first(root: Node, css: str) -> Node | None:
    """First match, or None; also None for a selector that can't be read."""
    try:
        return Selector(css).first(root)
    except ValueError:
        return None


def select_all(root: Node, css: str) -> list[Node]:
    """All matches in page order; none for a selector that can't be read."""
    try:
        return list(Selector(css).select(root))
    except ValueError:
        return []
