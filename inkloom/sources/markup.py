"""Chapters as trees: parsing of forgiving HTML, segmentation into blocks, and putting texts back."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

from inkloom.functions.placeholders import protect, restore
from inkloom.functions.text import DEFAULT_KIND, KINDS

#: Elements that make blocks, elements whose content is protected, elements without content.
BLOCK_TAGS = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "dt", "dd", "figcaption", "caption", "pre",
    "div", "section", "article", "aside", "header", "footer", "figure", "table", "tr", "ul", "ol",
}
PROTECTED_TAGS = ("code", "pre", "svg", "math", "script", "style")
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

#: An element of the key is closed by the start of an element of the value, as HTML lets its end tag be left out.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"caption", "td", "th", "tr"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "tr": {"tr"},
}


#: A policy: tags whose content is protected, each with the attribute values an element must have for that.
Policy = Mapping[str, Mapping[str, str]]
DEFAULT_POLICY: Policy = {tag: {} for tag in PROTECTED_TAGS}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or [], []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Node("#root")
        self.open = [self.root]

    def text(self, s: str) -> None:
        self.open[-1].children.append(s)

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in CLOSED_BY.get(self.open[-1].tag, ()):
            self.open.pop()
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag):
        names = [n.tag for n in self.open]
        if tag in names[1:]:
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.text(data)

    def handle_entityref(self, name):
        self.text(f"&{name};")

    def handle_charref(self, name):
        self.text(f"&#{name};")

    def handle_comment(self, data):
        self.open[-1].children.append(Node("#comment", [("data", data)]))


def parse(source: str) -> Node:
    b = _Builder()
    b.feed(source)
    b.close()
    return b.root


def outer(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    if node.tag == "#comment":
        return f"<!--{node.attrs[0][1]}-->"
    attrs = "".join(f" {k}" if v is None else f' {k}="{html.escape(v)}"' for k, v in node.attrs)
    if node.tag in VOID_TAGS:
        return f"<{node.tag}{attrs}/>"
    return f"<{node.tag}{attrs}>{inner(node)}</{node.tag}>"


def inner(node: Node) -> str:
    return "".join(map(outer, node.children))


def plain_text(node: Node) -> str:
    return html.unescape("".join(c if isinstance(c, str) else "" if c.tag == "#comment" else plain_text(c) for c in node.children))


def guarded(node: Node, policy: Policy) -> bool:
    """Whether the policy protects an element: its tag is named, and all attribute values asked for are there."""
    wanted = policy.get(node.tag)
    return wanted is not None and wanted.items() <= dict(node.attrs).items()


def blocks_of(root: Node, policy: Policy = DEFAULT_POLICY) -> Iterator[tuple[Node, str, bool]]:
    """(element, kind, protected) in document order; text outside of any block is passed over."""
    top = next((n for n in root.walk() if n.tag == "body"), root)

    def visit(node: Node):
        if guarded(node, policy):
            yield node, KINDS.get(node.tag, DEFAULT_KIND), True
        elif node.tag in BLOCK_TAGS and not any(n.tag in BLOCK_TAGS for n in node.walk()):
            yield node, KINDS.get(node.tag, DEFAULT_KIND), False
        else:
            for c in node.children:
                if isinstance(c, Node):
                    yield from visit(c)

    for c in top.children:
        if isinstance(c, Node):
            yield from visit(c)


def snippets(node: Node, policy: Policy = DEFAULT_POLICY) -> list[str]:
    return [outer(n) for n in node.walk() if guarded(n, policy)]


def segment(source: str, policy: Policy = DEFAULT_POLICY) -> list[dict]:
    """The blocks of a chapter: pos, kind, protected, text (inner markup; but for protected blocks, their protected parts
    as placeholders), saved."""
    out = []
    for pos, (node, kind, kept) in enumerate(blocks_of(parse(source), policy)):
        text, saved = (inner(node), {}) if kept else protect(inner(node), snippets(node, policy))
        out.append({"pos": pos, "kind": kind, "protected": kept, "text": text, "saved": saved})
    return out


def chapter_title(source: str, policy: Policy = DEFAULT_POLICY) -> str:
    """Plain text of the first heading that has any."""
    titles = (plain_text(node).strip() for node, kind, _ in blocks_of(parse(source), policy) if kind == "titulo")
    return next((t for t in titles if t), "")


def render(source: str, texts: Sequence[str | None], policy: Policy = DEFAULT_POLICY) -> str:
    """The chapter with its blocks' texts replaced: one text a block, or an error; where it is null or blank, and in
    protected blocks, all stays as it is."""
    root = parse(source)
    found = list(blocks_of(root, policy))
    if len(texts) != len(found):
        raise ValueError(f"{len(found)} blocks, but {len(texts)} texts")
    for (node, _, kept), new in zip(found, texts):
        if kept or not new or not new.strip():
            continue
        _, saved = protect(inner(node), snippets(node, policy))
        node.children = parse(restore(new, saved)).children
    head = re.match(r"\s*(<\?xml[^>]*\?>)?\s*(<!DOCTYPE[^>]*>)?", source, re.I)
    return "\n".join([*(g for g in head.groups() if g), "".join(outer(c) for c in root.children).strip()])


def link_labels(source: str) -> list[str]:
    """Text of every link, in document order."""
    return [plain_text(n) for n in parse(source).walk() if n.tag == "a"]
