"""HTML and XML documents as columns: CSS selection, formatted text, element text.

Parsing needs a tree, which no built-in offers for HTML; the functions are
Arrow-batched and take whole documents.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import each

#: Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}
HIDDEN = {"script", "style", "template", "noscript"}
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
TEXTS = pa.list_(pa.string())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """Visible text; a block starts and ends a word."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in HIDDEN or x is self:
                if x.tag in BLOCK:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(x.children))
        return " ".join("".join(out).split())


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES and self.at.tag in CLOSES[tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


_part = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]")


def compile_selector(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Comma lists of compounds with the combinator in front of each: descendant or child."""
    out = []
    for one in selector.split(","):
        steps, combinator = [], " "
        for word in re.sub(r"\s*>\s*", " > ", one.strip()).split():
            if word == ">":
                combinator = ">"
                continue
            parts = [m.groupdict() for m in _part.finditer(word)]
            if "".join(m[0] for m in _part.finditer(word)) != word:
                raise ValueError(f"selector not supported: {word}")
            steps.append((combinator, parts))
            combinator = " "
        if not steps:
            raise ValueError("empty selector")
        out.append(steps)
    return out


def fits(node: Node, parts: list[dict]) -> bool:
    for p in parts:
        if p["tag"]:
            ok = p["tag"] == "*" or node.tag == p["tag"].lower()
        elif p["id"]:
            ok = node.attrs.get("id") == p["id"]
        elif p["class"]:
            ok = p["class"] in node.attrs.get("class", "").split()
        else:
            have, want = node.attrs.get(p["attr"].lower()), p["value"]
            ok = have is not None and {None: lambda: True, "=": lambda: have == want, "*=": lambda: want in have, "^=": lambda: have.startswith(want), "$=": lambda: have.endswith(want), "~=": lambda: want in have.split()}[p["op"]]()
        if not ok:
            return False
    return True


def selected(root: Node, selector: list) -> list[Node]:
    def holds(node: Node, steps: list) -> bool:
        if not fits(node, steps[-1][1]):
            return False
        if len(steps) == 1:
            return True
        up = node.parent
        while up is not None:
            if holds(up, steps[:-1]):
                return True
            if steps[-1][0] == ">":
                return False
            up = up.parent
        return False

    return [n for n in root.walk() if n.tag and any(holds(n, steps) for steps in selector)]


def only_ampersands(c: Column) -> Column:
    """Markup in which no reference but `&amp;` means a character: any other one, whole or cut off, is text as written."""
    return F.regexp_replace(c, "&(?!amp;)", "&amp;")


def css_text(c: Column, selector: str) -> Column:
    steps = compile_selector(selector)
    return each(lambda html: None if html is None else [n.text() for n in selected(parse_html(html), steps)], TEXTS, c)


def css_attribute(c: Column, selector: str, name: str) -> Column:
    steps = compile_selector(selector)
    return each(lambda html: None if html is None else [n.attrs[name] for n in selected(parse_html(html), steps) if name in n.attrs], TEXTS, c)


def css_all(c: Column, wanted: list[tuple[str, str | None]]) -> Column:
    """struct(c0, c1, ...) of what each (selector, attribute; None for text) finds: one parse of the document for all."""
    compiled = [(compile_selector(s), a) for s, a in wanted]

    def found(html: str | None):
        if html is None:
            return None
        tree = parse_html(html)
        return {f"c{i}": [n.text() if a is None else n.attrs[a] for n in selected(tree, steps) if a is None or a in n.attrs] for i, (steps, a) in enumerate(compiled)}

    return each(found, pa.struct([(f"c{i}", TEXTS) for i in range(len(wanted))]), c)


def html_to_text(c: Column) -> Column:
    return each(lambda html: None if html is None else parse_html(html).text(), pa.string(), c)


def _xml(body: str | None):
    try:
        return ElementTree.fromstring(body) if body else None
    except ElementTree.ParseError:
        return None


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def xml_texts(body: str | None, path: str) -> list[str] | None:
    """Texts of the elements at a slash path of local names; the first may be the root. Null if malformed."""
    root = _xml(body)
    if root is None:
        return None
    names = path.split("/")
    nodes = [root] if _local(root.tag) == names[0] else [n for n in root if _local(n.tag) == names[0]]
    for name in names[1:]:
        nodes = [k for n in nodes for k in n if _local(k.tag) == name]
    return [" ".join(t.strip() for t in n.itertext() if t.strip()) for n in nodes]


def xml_text(c: Column, path: str) -> Column:
    return each(lambda body: xml_texts(body, path), TEXTS, c)


def xml_element(c: Column, name: str) -> Column:
    """Texts of all descendants with a local name."""
    return each(lambda body: None if (root := _xml(body)) is None else [" ".join("".join(n.itertext()).split()) for n in root.iter() if _local(n.tag) == name], TEXTS, c)


def xml_valid(c: Column) -> Column:
    return xml_element(c, "").isNotNull()


def sitemap_urls(c: Column, pattern: str | None = None) -> Column:
    """Collapsed, non-empty `loc` texts, optionally only those that match; null if the body is malformed."""
    found = F.filter(xml_element(c, "loc"), lambda x: x != "")
    return F.filter(found, lambda x: x.rlike(pattern)) if pattern else found
