"""CSS selectors over parsed pages, in Arrow batches.

Supported: type, *, #id, .class, [a], [a=v], ^= $= *= ~= |= (with the flags i and
s), compounds, :not(...), :is(...), :where(...), :empty, :root, :nth-, :nth-last-,
:first-, :last- and :only- with child or of-type, descendant, child, both kinds of
sibling, and comma. Anything else raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import MARKUP_CHARS
from ..workers import ship

#: Pages whose trees are built of one slice of a batch.
SLICE = 256

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SIMPLE = re.compile(r"""\*|([A-Za-z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([\^$*~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*([iIsS]\s*)?)?\]|:([a-z-]+)(?:\(((?:[^()]|\([^()]*\))*)\))?""")
COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
#: Case of ASCII letters alone, as attribute flags fold it.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STEP = re.compile(r"([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+)")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    content: list = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    place: int = 0
    tag_pos: int = 0

    def markup(self, limit: int | None = None) -> str:
        """Outer HTML; with a limit, cut soon after so many characters."""
        out, todo, size = [], [self], 0
        while todo and (limit is None or size <= limit):
            at = todo.pop()
            size += len(at) if isinstance(at, str) else len(at.tag) + 2
            if isinstance(at, str):
                out.append(at)
                continue
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in at.attrs.items())
            out.append(f"<{at.tag}{attrs}>")
            if at.tag not in VOID:
                todo += [f"</{at.tag}>", *reversed(at.content)]
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.root = self.here = Node("", {})
        self.nodes: list[Node] = []
        self.tags: dict[str, int] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.here, place=len(self.here.children), tag_pos=self.tags.get(tag, 0))
        self.tags[tag] = node.tag_pos + 1
        self.here.content.append(node)
        self.here.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.here.tag == tag and tag not in VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        node = self.here
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.here = node.parent

    def handle_data(self, data):
        self.here.content.append(data)

    def handle_entityref(self, name):
        self.here.content.append(f"&{name};")

    def handle_charref(self, name):
        self.here.content.append(f"&#{name};")


def _nth(text: str) -> tuple[int, int]:
    """(a, b) of an+b."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip().lower(), text.strip().lower())
    m = STEP.fullmatch(text)
    if not m:
        raise ValueError(f"unsupported step: {text!r}")
    a, sign, b, only = m.groups()
    if only:
        return 0, int(only)
    return int(a + "1" if a in ("", "+", "-") else a), int((sign or "+") + (b or "0"))


def _pseudo(name: str, argument: str | None) -> tuple:
    if name in ("not", "is", "where") and argument:
        return ("not" if name == "not" else "is", compile_selector(argument))
    place, _, among = name.rpartition("-of-") if name.endswith("-of-type") else name.rpartition("-")
    if among in ("child", "type"):
        if place in ("nth", "nth-last") and argument:
            return ("nth", among == "type", place == "nth-last", *_nth(argument))
        if place in ("first", "last", "only") and argument is None:
            return (place, among == "type")
    if name in ("empty", "root") and argument is None:
        return (name,)
    raise ValueError(f"unsupported selector: :{name}")


def compile_selector(text: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives; each a list of (combinator, tests), right-most last."""
    out = []
    for part in re.split(r",(?![^\[]*\])(?![^(]*\))", text):
        part, chain, at, combinator = part.strip(), [], 0, " "
        if not part:
            raise ValueError(f"unsupported selector: {text!r}")
        while at < len(part):
            tests = []
            while at < len(part) and (m := SIMPLE.match(part, at)):
                tag, ident, cls, name, op, *values, case, pseudo, argument = m.groups()
                value = next((v for v in values if v is not None), None)
                folded = (case or "").strip() in ("i", "I")
                tests.append(("tag", tag.lower()) if tag else ("attr", "id", "=", ident, False) if ident else ("class", cls) if cls else ("attr", name.lower(), op, value, folded) if name else _pseudo(pseudo, argument) if pseudo else ("any",))
                at = m.end()
            if not tests:
                raise ValueError(f"unsupported selector: {text!r}")
            chain.append((combinator, tests))
            gap = COMBINATOR.match(part, at)
            if at < len(part):
                if not gap or gap.end() == len(part):
                    raise ValueError(f"unsupported selector: {text!r}")
                combinator, at = gap[1] or " ", gap.end()
        out.append(chain)
    return out


def _around(node: Node, typed: bool) -> tuple[int, int]:
    """How many siblings stand before and after; typed: of the same tag."""
    if not typed:
        return node.place, len(node.parent.children) - 1 - node.place
    same = [n.place for n in node.parent.children if n.tag == node.tag]
    at = same.index(node.place)
    return at, len(same) - 1 - at


def _passes(node: Node, tests: list[tuple]) -> bool:
    for kind, *rest in tests:
        if kind == "tag" and node.tag != rest[0]:
            return False
        if kind == "class" and rest[0] not in node.attrs.get("class", "").split():
            return False
        if kind == "attr":
            name, op, value, folded = rest
            have = node.attrs.get(name)
            if folded and have is not None and value is not None:
                have, value = have.translate(LOWER), value.translate(LOWER)
            if have is None or (op == "=" and have != value):
                return False
            if op == "~=" and (not value or value not in have.split()):
                return False
            if op == "|=" and have != value and not have.startswith(f"{value}-"):
                return False
            if op in ("^=", "$=", "*=") and not (value and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](value)):
                return False
        if kind == "not" and any(selects(c, node) for c in rest[0]):
            return False
        if kind == "is" and not any(selects(c, node) for c in rest[0]):
            return False
        if kind == "empty" and any(node.content):
            return False
        if kind == "root" and (node.parent.tag or node.place != 0):
            return False
        if kind == "nth":
            typed, last, a, b = rest
            before, after = _around(node, typed)
            far = (after if last else before) + 1 - b
            if (far != 0) if a == 0 else (far % a != 0 or far // a < 0):
                return False
        if kind in ("first", "last", "only"):
            before, after = _around(node, rest[0])
            if (kind != "last" and before) or (kind != "first" and after):
                return False
    return True


def selects(chain: list[tuple[str, list[tuple]]], node: Node) -> bool:
    combinator, tests = chain[-1]
    if not _passes(node, tests):
        return False
    if len(chain) == 1:
        return True
    if combinator in "+~":
        before = node.parent.children[: node.place]
        return any(selects(chain[:-1], n) for n in (before[-1:] if combinator == "+" else reversed(before)))
    up = node.parent
    while up and up.tag:
        if selects(chain[:-1], up):
            return True
        if combinator == ">":
            return False
        up = up.parent
    return False


COLUMNS = ("href", "src", "alt", "title", "width", "height")
#: Kinds of records by tag; any other selected element is of kind `selected`.
RECORDS = {"a": "link", "img": "image", "iframe": "iframe"}
KINDS = {
    "page_id": pa.int64(), "document": pa.string(), "kind": pa.string(), "node_pos": pa.int32(), "markup": pa.string(), **{c: pa.string() for c in COLUMNS},
    "tag": pa.string(), "tag_pos": pa.int32(), "selected": pa.bool_(), "tree_pos": pa.int32(),
}
DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}


def _found(pages: DataFrame, selector: str, wanted: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """Columns wanted of the elements that a selector matches, and of all
    elements of the tags `also`, in one pass over the trees of pages."""
    compile_selector(selector)
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = compile_selector(selector)
        for b in (batch.slice(i, SLICE) for batch in batches for i in range(0, len(batch), SLICE)):
            out: dict[str, list] = {n: [] for n in wanted}
            for page, url, html in zip(*[b.column(n).to_pylist() for n in ("page_id", "url", "html")]):
                for i, node in enumerate(_Tree(html or "").nodes):
                    selected = any(selects(c, node) for c in chains)
                    if not selected and node.tag not in also:
                        continue
                    record = node.tag in also
                    values = {
                        "page_id": page, "document": url, "kind": RECORDS[node.tag] if record else "selected", "node_pos": node.tag_pos if record else i,
                        "tag": node.tag, "tag_pos": node.tag_pos, "selected": selected, "tree_pos": i,
                    }
                    for n in wanted:
                        out[n].append(values[n] if n in values else node.markup(MARKUP_CHARS) if n == "markup" else node.attrs.get(n))
            yield pa.RecordBatch.from_arrays([pa.array(v, KINDS[n]) for n, v in out.items()], names=list(out))

    return pages.select("page_id", "url", "html").mapInArrow(run, ", ".join(f"{n} {DDL[KINDS[n]]}" for n in wanted))


def select_elements(pages: DataFrame, selector: str) -> DataFrame:
    """Elements of pages(page_id, url, html) that a selector matches."""
    return _found(pages, selector, ("page_id", "document", "kind", "node_pos", "markup", *COLUMNS))


def select_places(pages: DataFrame, selector: str) -> DataFrame:
    """page_id, tag and tag_pos (place among the page's elements of that tag) of
    the elements that a selector matches."""
    return _found(pages, selector, ("page_id", "tag", "tag_pos"))


def page_elements(pages: DataFrame, selector: str) -> DataFrame:
    """Links, images, iframes and selected elements of pages, each once, with
    `selected` and `tree_pos`, its place among all elements of the page."""
    return _found(pages, selector, ("page_id", "document", "kind", "node_pos", "markup", *COLUMNS, "selected", "tree_pos"), tuple(RECORDS))
