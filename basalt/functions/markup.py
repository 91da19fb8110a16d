"""Pages as trees in columns: one Arrow pass lays a page's elements and texts out in arrays, and everything else
(selectors, texts, label and value pairs) is an expression over these arrays, so that nothing is shuffled.

An element knows the last element inside it, so that what lies within is a slice. Null pages and pages without
elements have empty arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: An element: its place, the last place within, its parent's, tag, id, classes, attributes, and its pieces of text [t0, t1).
_ELEMENT = "struct<at:int,last:int,up:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,t0:int,t1:int>"
#: A piece: the element that it lies in directly; kind 0 is text, 1 a line break, 2 a paragraph's end.
_PIECE = "struct<of:int,kind:int,s:string>"
DOM = f"struct<elements:array<{_ELEMENT}>,pieces:array<{_PIECE}>>"

# Elements without content, and which open elements a start tag ends, up to the element that bounds the search.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})} | {
    tag: ({"p"}, {"button", "table", "td", "th", "caption"}) for tag in _BLOCKS
}
#: White space as scripts in pages know it.
WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.pieces: list[tuple] = []
        self.open: list[int] = []

    def _leave(self, depth: int) -> None:
        """Ends the open elements from a depth on."""
        while len(self.open) > depth:
            at = self.open.pop()
            if self.elements[at][3] == "p":
                self.pieces.append((at, 2, ""))
            self.elements[at][1] = len(self.elements) - 1
            self.elements[at][8] = len(self.pieces)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended, bounds = _ENDS.get(tag, ((), ()))
        lowest = None
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[depth]][3]
            if name in bounds:
                break
            if name in ended:
                lowest = depth
                if tag not in ("tr",):
                    break
        if lowest is not None:
            self._leave(lowest)
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        at = len(self.elements)
        self.elements.append([at, at, self.open[-1] if self.open else -1, tag, known.get("id"), known.get("class", "").split(), list(known.items()), len(self.pieces), len(self.pieces)])
        if tag == "br":
            self.pieces.append((at, 1, ""))
            self.elements[at][8] = len(self.pieces)
        elif tag not in _VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends nothing in markup

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]][3] == tag:
                self._leave(depth)
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1] if self.open else -1, 0, data))


def tree(html: str | None) -> dict:
    """A page's elements in document order and its pieces of text; scripts and styles are text of their elements."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    t._leave(0)
    names = ("at", "last", "up", "tag", "id", "classes", "attrs", "t0", "t1")
    return {"elements": [dict(zip(names, e)) for e in t.elements], "pieces": [dict(zip(("of", "kind", "s"), p)) for p in t.pieces]}


_INT, _STRING = pa.int32(), pa.string()
_ARROW = pa.struct(
    [
        ("elements", pa.list_(pa.struct([*((c, _INT) for c in ("at", "last", "up")), ("tag", _STRING), ("id", _STRING), ("classes", pa.list_(_STRING)), ("attrs", pa.map_(_STRING, _STRING)), ("t0", _INT), ("t1", _INT)]))),
        ("pieces", pa.list_(pa.struct([("of", _INT), ("kind", _INT), ("s", _STRING)]))),
    ]
)


def with_dom(pages: DataFrame, html: str = "html", into: str = "dom") -> DataFrame:
    """Adds the tree of ``html``. Rows stay where they are."""
    rest = [c for c in pages.columns if c != into]
    schema = StructType([pages.schema[c] for c in rest]).add(into, _parse_datatype_string(DOM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            for a in range(0, batch.num_rows, 64):  # trees are larger than their pages
                part = batch.column(at).slice(a, 64)
                trees = pa.array([tree(x) for x in part.to_pylist()], _ARROW)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 64) for c in kept), trees], names=[*rest, into])

    return pages.mapInArrow(run, schema)


_SIMPLE = re.compile(r"""([\w-]+)|\#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$]?=)['"]?([^'"\]]*)['"]?)?\]""")


def _compound(selector: str):
    """A test of an element for a selector without combinators."""
    tests, at = [], 0
    while at < len(selector):
        m = _SIMPLE.match(selector, at)
        if not m:
            raise ValueError(f"a selector beyond tags, ids, classes and attributes: {selector!r}")
        tag, id_, cls, name, how, value = m.groups()
        if tag:
            tests.append(lambda e, v=tag: e["tag"] == v)
        elif id_:
            tests.append(lambda e, v=id_: e["id"] == v)
        elif cls:
            tests.append(lambda e, v=cls: F.array_contains(e["classes"], v))
        else:
            way = {None: lambda x, v: x.isNotNull(), "=": lambda x, v: x == v, "*=": lambda x, v: x.contains(v), "^=": lambda x, v: x.startswith(v), "$=": lambda x, v: x.endswith(v)}[how]
            tests.append(lambda e, n=name, v=value, way=way: way(F.try_element_at(e["attrs"], F.lit(n)), v))
        at = m.end()

    def test(e: Column) -> Column:
        out = tests[0](e)
        for t in tests[1:]:
            out = out & t(e)
        return F.coalesce(out, F.lit(False))

    return test


def held(x: Column, of) -> Column:
    """``of(x)``, with ``x`` computed once however often ``of`` names it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def select(elements: Column, selector: str) -> Column:
    """The elements that a selector names, in document order: tags, ids, classes, attributes, descendants, commas. All its ways
    are tests of one pass over the elements; what a descendant lies in is selected once, before that pass."""
    ways = [[_compound(part) for part in way.split()] for way in selector.split(",")]

    def found(ways: list, tests: list) -> Column:
        if not ways:
            return F.filter(elements, lambda e: reduce(or_, (t(e) for t in tests)))
        *outer, test = ways[0]
        if not outer:
            return found(ways[1:], [*tests, test])
        return held(found([outer], []), lambda around: found(ways[1:], [*tests, lambda e: test(e) & F.exists(around, lambda o: (o["at"] < e["at"]) & (e["at"] <= o["last"]))]))

    return found(ways, [])


def first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))


def within(dom: Column, element: Column) -> Column:
    """What lies in an element; nothing in null."""
    return F.when(element["at"].isNotNull(), F.slice(dom["elements"], element["at"] + 2, element["last"] - element["at"])).otherwise(F.slice(dom["elements"], 1, 0))


def next_sibling(dom: Column, element: Column) -> Column:
    after = F.get(dom["elements"], element["last"] + 1)
    return F.when(after["up"] == element["up"], after)


def parent(dom: Column, element: Column) -> Column:
    return F.when(element["up"] >= 0, F.get(dom["elements"], element["up"]))


def attr(element: Column, name: str) -> Column:
    return F.try_element_at(element["attrs"], F.lit(name))


def _own(dom: Column, element: Column) -> Column:
    return F.slice(dom["pieces"], element["t0"] + 1, element["t1"] - element["t0"])


def text(dom: Column, element: Column) -> Column:
    """All text in an element; null for none."""
    return F.array_join(F.transform(F.filter(_own(dom, element), lambda p: p["kind"] == 0), lambda p: p["s"]), "")


def text_but(dom: Column, element: Column, selector: str) -> Column:
    """All text in an element that doesn't lie in what the selector names."""
    out = select(within(dom, element), selector)
    return F.array_join(F.transform(F.filter(_own(dom, element), lambda p: (p["kind"] == 0) & ~F.exists(out, lambda o: (o["at"] <= p["of"]) & (p["of"] <= o["last"]))), lambda p: p["s"]), "")


def lines(dom: Column, element: Column, but: str) -> Column:
    """An element's lines, parted by line breaks, breaks in the text and paragraphs' ends, without what ``but`` names and
    blank ones; white space single."""
    out = select(within(dom, element), but)
    kept = F.filter(_own(dom, element), lambda p: ~F.exists(out, lambda o: (o["at"] <= p["of"]) & (p["of"] <= o["last"])))
    whole = F.array_join(F.transform(kept, lambda p: F.when(p["kind"] == 0, p["s"]).otherwise("\n")), "")
    return F.filter(F.transform(F.split(whole, "\n+"), squeezed), lambda x: x != "")


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def squeezed(x: Column) -> Column:
    """White space single, none at the ends."""
    return trimmed(F.regexp_replace(x, f"{WS}+", " "))


def filled(x: Column) -> Column:
    """Null for an empty text."""
    return F.when(x != "", x)


def body(dom: Column, between: str = "") -> Column:
    """The text of the page's body, or of all where there is no body; ``between`` parts its pieces."""
    found = first(select(dom["elements"], "body"))
    pieces = F.when(found["at"].isNotNull(), _own(dom, found)).otherwise(dom["pieces"])
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["kind"] == 0), lambda p: p["s"]), between)


def pairs(dom: Column, rows: Column, label: str, value: str, but: str) -> Column:
    """``label, value`` of each row: the text of the first element in it that either selector names (for a value, else
    of the row itself), white space single, labels in lower case without a colon."""

    def of(row: Column) -> Column:
        inside = within(dom, row)
        given = first(select(inside, value))
        given = F.when(given["at"].isNotNull(), text_but(dom, given, but)).otherwise(text_but(dom, row, but))
        return F.struct(label_of(F.coalesce(text(dom, first(select(inside, label))), F.lit(""))).alias("label"), squeezed(given).alias("value"))

    return F.filter(F.transform(rows, of), lambda p: (p["label"] != "") & (p["value"] != ""))


def label_of(x: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(F.regexp_replace(x, f"{WS}+", " "), ":$", "")))


def definitions(dom: Column, terms: Column, label: str, but: str) -> Column:
    """``label, lines`` of each term: that of the first texts in it that ``label`` names, else its own; the lines of the
    ``dd`` right after it."""

    def of(term: Column) -> Column:
        named = F.array_join(F.transform(select(within(dom, term), label), lambda e: text(dom, e)), "")
        given = next_sibling(dom, term)
        given = F.when(given["tag"] == "dd", given)
        name = label_of(F.coalesce(filled(named), text(dom, term)))
        return F.struct(name.alias("label"), F.coalesce(lines(dom, given, but), F.array().cast("array<string>")).alias("lines"))

    return F.filter(F.transform(terms, of), lambda p: (p["label"] != "") & (F.size(p["lines"]) > 0))
