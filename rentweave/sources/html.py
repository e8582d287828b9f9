"""HTML pages as arrays of elements, selected with native array functions.

One narrow Python step turns markup into a flat element array per page; everything
after it (selection, field rules) is Column expressions. Elements point into the
page text instead of carrying their own copy, so nested markup costs no extra space.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, has, trim_ws

ELEMENTS = (
    "array<struct<seq:int,end_seq:int,parent:int,tag:string,classes:array<string>,"
    "attrs:map<string,string>,run:int,runs:int>>"
)

# Tags without content, and which open tags a new tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{tag: ({"p"}, {"td", "th", "li", "button"}) for tag in _BLOCKS},
}


_TOKEN = re.compile(
    r"""<(?:(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>?|!--.*?(?:-->|\Z)|[!?][^>]*>?)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Tags whose content is text only, with and without character references.
_RAW_TEXT, _PLAIN_TEXT = frozenset(("script", "style")), frozenset(("title", "textarea"))
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in _RAW_TEXT | _PLAIN_TEXT}
_NONE: dict[str, str] = {}


_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);")


def _unescape_whole(text: str) -> str:
    """Character references that end in a semicolon replaced, all others left as they are."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], text)


def _attributes(text: str, decode: Callable[[str], str] = unescape) -> dict[str, str]:
    values: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        value = double or single or bare
        values.setdefault(name.lower(), decode(value) if "&" in value else value)
    return values


#: Attribute texts up to this size are read once a worker; a site's templates repeat them from page to page.
_SHORT = 128
_short_attributes = lru_cache(4096)(_attributes)


def shred(markup: str, cut_references: bool = True) -> tuple[list[str], list[list]]:
    """Text runs and elements [tag, parent, end_seq, attributes, run, runs] in document order.

    Browsers also read references that lack their semicolon ("&amp" at the end of a cut text); without
    ``cut_references`` those are text.
    """
    decode = unescape if cut_references else _unescape_whole
    elements: list[list] = []
    opened: list[int] = []
    depths: dict[str, list[int]] = {}  # of each open tag, where in ``opened`` it stands
    texts: list[str] = []
    at, size = 0, len(markup)

    def close(depth: int) -> None:
        until, behind = len(elements), len(texts)
        while len(opened) > depth:
            element = elements[opened.pop()]
            element[2] = until
            element[5] = behind - element[4]
            depths[element[0]].pop()

    def add_text(text: str, references: bool = True) -> None:
        if text:
            texts.append(decode(text) if references and "&" in text else text)

    going = True
    while going:
        going = False
        for token in _TOKEN.finditer(markup, at):
            start, end = token.span()
            if start > at:
                text = markup[at:start]
                texts.append(decode(text) if "&" in text else text)
            at = end
            closing, tag, rest = token.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                if places := depths.get(tag):
                    close(places[-1])
                continue
            # mostly no tag that this one closes is open
            if (rules := _CLOSES.get(tag)) and (open_tags := [places for name in rules[0] if (places := depths.get(name))]):
                stop = max([depths[name][-1] for name in rules[1] if depths.get(name)], default=-1)
                # all open tags of this kind above the nearest stop: the outermost takes the others with it
                hits = [places[bisect_right(places, stop)] for places in open_tags if places[-1] > stop]
                if hits:
                    close(min(hits))
            seq = len(elements)
            attributes = (_short_attributes if len(rest) <= _SHORT else _attributes)(rest, decode) if rest else _NONE
            elements.append([tag, opened[-1] if opened else -1, seq + 1, attributes, len(texts), 0])
            if tag in VOID:
                continue
            if (places := depths.get(tag)) is None:
                depths[tag] = [len(opened)]
            else:
                places.append(len(opened))
            opened.append(seq)
            if tag in _RAW_TEXT or tag in _PLAIN_TEXT:
                found = _RAW_END[tag].search(markup, at)
                stop = found.start() if found else size
                add_text(markup[at:stop], tag in _PLAIN_TEXT)
                at, going = stop, True  # what looked like tags inside is passed over
                break
    add_text(markup[at:])
    close(0)
    return texts, elements


def _offsets(sizes: list[int | None]) -> pa.Array:
    """Arrow list offsets; a null size marks a null list."""
    out, total = [], 0
    for n in sizes:
        out.append(total if n is not None else None)
        total += n or 0
    return pa.array([*out, total], pa.int32())


def _element_array(pages: list[list[list] | None]) -> pa.Array:
    """Arrow form of the elements of some pages."""
    flat = [e for elements in pages if elements for e in elements]
    seqs = [i for elements in pages if elements for i in range(len(elements))]
    classes = [e[3]["class"].split() if "class" in e[3] else [] for e in flat]
    columns = {
        "seq": pa.array(seqs, pa.int32()),
        "end_seq": pa.array([e[2] for e in flat], pa.int32()),
        "parent": pa.array([e[1] for e in flat], pa.int32()),
        "tag": pa.array([e[0] for e in flat], pa.string()),
        "classes": pa.ListArray.from_arrays(
            _offsets([len(c) for c in classes]), pa.array([x for c in classes for x in c], pa.string())
        ),
        "attrs": pa.MapArray.from_arrays(
            _offsets([len(e[3]) for e in flat]),
            pa.array([k for e in flat for k in e[3]], pa.string()),
            pa.array([v for e in flat for v in e[3].values()], pa.string()),
        ),
        "run": pa.array([e[4] for e in flat], pa.int32()),
        "runs": pa.array([e[5] for e in flat], pa.int32()),
    }
    structs = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(_offsets([None if p is None else len(p) for p in pages]), structs)


def shred_pages(pages: DataFrame, html: str = "html", cut_references: bool = True) -> DataFrame:
    """Replace the markup column by ``text_runs`` and ``elements``; one row per page (``cut_references``: see ``shred``).

    Small output chunks keep a batch of large pages within a worker's memory.
    """
    carried = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(
        [*carried, T.StructField("text_runs", T.ArrayType(T.StringType())), T.StructField("elements", T._parse_datatype_string(ELEMENTS))]
    )
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                shredded = [(None, None) if m is None else shred(m, cut_references) for m in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(n) for n in names],
                        pa.array([s[0] for s in shredded], pa.list_(pa.string())),
                        _element_array([s[1] for s in shredded]),
                    ],
                    names=[*names, "text_runs", "elements"],
                )

    return pages.mapInArrow(run, schema)


# --- selection -----------------------------------------------------------------------

ELS = "elements"


def own_text(e: Column) -> Column:
    """Text of an element and everything inside it."""
    return F.array_join(F.slice("text_runs", e["run"] + 1, e["runs"]), "")


def element_text(e: Column) -> Column:
    """Trimmed text of an element and everything inside it."""
    return trim_ws(own_text(e))


def select(where, elements: Column | str = ELS) -> Column:
    return F.filter(elements, where)


def tagged(*tags: str):
    return lambda e: e["tag"].isin(*tags)


def classed(name: str):
    return lambda e: F.array_contains(e["classes"], name)


def class_part(text: str):
    return lambda e: F.coalesce(has(F.try_element_at(e["attrs"], F.lit("class")), text), F.lit(False))


def inside(e: Column, outer: Column) -> Column:
    return (e["seq"] > outer["seq"]) & (e["seq"] < outer["end_seq"])


def first(elements: Column) -> Column:
    return F.try_element_at(elements, F.lit(1))


def last(elements: Column) -> Column:
    return F.try_element_at(elements, F.lit(-1))


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def first_text(where) -> Column:
    """Text of the first match, null when there is none or it is empty."""
    return blank_to_null(element_text(first(select(where))))


def all_text(where) -> Column:
    return F.filter(F.transform(select(where), element_text), lambda t: t != "")


def first_attr(where, name: str) -> Column:
    return blank_to_null(trim_ws(attr(first(select(where)), name)))


def all_attrs(where, name: str) -> Column:
    values = F.transform(select(where), lambda e: trim_ws(attr(e, name)))
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))
