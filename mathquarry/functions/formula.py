"""Structural features of formulas in MathML, as table functions.

Each formula is read into a small tree; the three feature sets are walks over it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, groupby
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that only group others.
TRANSPARENT = frozenset(("math", "mrow", "mfence"))
MAX_LENGTH = 200


@dataclass(eq=False)
class Node:
    name: str
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    text: str = ""

    @property
    def is_operator(self) -> bool:
        """The first child of an ``apply``."""
        return self.parent is not None and self.parent.name == "apply" and self.parent.children[0] is self

    def path(self) -> list[Node]:
        """From below the root to this node."""
        out, node = [], self
        while node.parent is not None:
            out.append(node)
            node = node.parent
        return out[::-1]


def tree(xml: str | None, transparent: frozenset = frozenset()) -> Node | None:
    """The formula below a root node; None for null, empty or malformed markup."""
    if not xml:
        return None
    root = here = Node("")
    opened: list[Node] = []  # where each open element puts what it holds

    def start(name, _):
        nonlocal here
        opened.append(here)
        if name not in transparent:
            node = Node(name, here)
            here.children.append(node)
            here = node

    def end(_):
        nonlocal here
        here = opened.pop()

    def text(data):
        if here is not root:
            here.text += data.strip()

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, UnicodeEncodeError):
        return None
    return root


def walk(node: Node):
    """The nodes below, parents first."""
    stack = node.children[::-1]
    while stack:
        n = stack.pop()
        yield n
        stack += n.children[::-1]


def kristianto(xml: str | None) -> list[str]:
    """``o:`` ordered paths, ``u:`` unordered paths and ``s:`` pairs of neighbouring sibling leaves.

    A leaf that opens the formula, nothing being before it, has no features: so it is in the
    published feature set, and counts are comparable only if it stays so.
    """
    root = tree(xml, TRANSPARENT)
    if root is None:
        return []
    nodes = list(walk(root))
    leaves = [n for n in nodes if not n.children]
    if nodes and not nodes[0].children:
        leaves = leaves[1:]
    label = lambda n: f"{n.name}#{n.text}" if n.text else n.name
    place: dict[int, int] = {id(c): i for n in [root, *nodes] for i, c in enumerate(n.children, 1)}
    ordered, unordered = [], []
    for leaf in leaves:
        path = leaf.path()
        branches = [str(place[id(n)]) for n in path[1:]]  # the branch taken at each ancestor
        for i in range(len(path)):
            ordered.append("o:" + "#".join([*branches[i:], label(leaf)]))
            unordered.append("u:" + "#" * (len(path) - 1 - i) + label(leaf))
    pairs = [f"s:{label(a)}-{label(b)}" for _, group in groupby(leaves, key=lambda n: id(n.parent)) for a, b in combinations(list(group), 2)]
    return ordered + unordered + pairs


def _serialized(n: Node) -> str | None:
    if n.is_operator:
        return None
    head = [n.children[0].name] if n.name == "apply" and n.children else [n.text] if n.name != "apply" and n.text else []
    inner = [s for s in map(_serialized, n.children) if s is not None]
    return f"{n.name}({'#'.join(head + ['>'.join(inner)] * bool(inner))})"


def _generalized(n: Node) -> str:
    if n.is_operator:
        return n.name
    return f"{n.name}({n.children[0].name if n.name == 'apply' and n.children else ''})"


def lin(xml: str | None, max_length: int | None = MAX_LENGTH) -> list[str]:
    """Serialised subtrees, and generalised ones whose children lose their own children; longer tokens are dropped."""
    root = tree(xml)
    if root is None:
        return []
    out: list[str] = []

    def visit(n: Node) -> None:
        if not n.children:
            if n.text:
                out.append(f"{n.name}({n.text})")
            return
        if not n.is_operator:
            out.append(_serialized(n))
        for c in n.children:
            visit(c)
        out.append(f"{n.name}({'>'.join(map(_generalized, n.children))})")

    try:
        if root.children:
            visit(root.children[0])
    except RecursionError:  # nested deeper than any formula
        return []
    return out if max_length is None else [t for t in out if len(t) <= max_length]


def content_features(xml: str | None) -> list[str]:
    """``opr:`` names of operators, ``sym:`` texts of identifiers, ``num:`` texts of numbers, in document order."""
    root = tree(xml)
    if root is None:
        return []
    out = []
    for n in walk(root):
        if n.is_operator:
            out.append(f"opr:{n.name}")
        if n.name in ("ci", "cn") and n.text:
            out.append(f"{'sym' if n.name == 'ci' else 'num'}:{n.text}")
    return out


METHODS = {"kristianto": kristianto, "lin": lin, "content": content_features}


def formula_tokens(formulas: DataFrame, method: str, markup: str = "c_math_ml", max_length: int | None = MAX_LENGTH) -> DataFrame:
    """``formulas`` with ``tokens``, its markup column taken away. Null, empty and malformed markup has no tokens."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {', '.join(METHODS)}")
    others = [f for f in formulas.schema.fields if f.name != markup]
    names = [f.name for f in others]
    of = METHODS[method] if method != "lin" else lambda x: lin(x, max_length)

    def run(batches):
        known: dict = {}
        for b in batches:
            found = []
            for x in b.column(markup).to_pylist():
                if x not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[x] = of(x)
                found.append(known[x])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, pa.list_(pa.string()))], names=[*names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", tokens array<string>"
    return formulas.select(*names, markup).mapInArrow(run, schema)


def without_numbers(token) -> Column:
    return ~token.startswith("num")
