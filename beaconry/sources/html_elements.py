"""Element table: one row per HTML element, in document order.

Parsing is the only step that needs Python.  It is a narrow pass over Arrow batches
of pages that gives out elements a few pages at a time; everything later works relationally on its output.  Clustered
element tables are shuffled once by ``page_id``, with only the columns that are
used later; windows and aggregations by page then need no further exchange.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame


ELEMENT_FIELDS = {
    "pos": "int", "last": "int", "parent": "int", "parent_last": "int", "tag": "string",
    "attrs": "map<string,string>", "text": "string", "raw": "string", "single": "string",
}
#: Characters of pages that a task turns into Python objects at a time.
SLICE_CHARS = 500_000

# HTML element classes.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
OPAQUE_TAGS = frozenset(["script", "style", "template"])
HEADING_TAGS = frozenset(["h1", "h2", "h3"])
RAW_TEXT_TAGS = frozenset(["pre", "code", "h1", "h2", "h3", "h4", "h5", "h6"])
TEXT_TAGS = RAW_TEXT_TAGS | frozenset(
    "title p div li ul ol a td th dt dd blockquote span b i em strong".split()
)
BLOCK_TAGS = frozenset(
    "address blockquote center dd div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li ol p pre "
    "table tbody td tfoot th tr ul".split()
)
INLINE_TAGS = frozenset("b big font i s small strike tt u".split())
# An open element (key) ends when one of these starts.
IMPLIED_END = {
    "p": BLOCK_TAGS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
    **{tag: frozenset(["center", "p", "td", "th"]) for tag in INLINE_TAGS},
    **{f"h{n}": frozenset(["fieldset", "form", "li", "p", "table"]) for n in range(1, 7)},
}
# An end tag never closes past an open element of higher rank.
CLOSE_RANK = {
    "div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4,
    "table": 5, "head": 6, "body": 6, "html": 7,
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(
    r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?"
)
# Named references count only with their semicolon; numeric ones also without.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)")


def _unescape(value: str) -> str:
    if "&" not in value:
        return value
    return REFERENCE.sub(lambda m: html.unescape(m[0]), value)


def _attributes(source: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), _unescape(double or single or bare))
    return list(found.items())


class _Page:
    """Open-element stack for one page; ``rows`` are in document order."""

    def __init__(self, implied_ends: bool) -> None:
        self.implied_ends = implied_ends
        self.rows: list[dict] = []
        self.open: list[tuple[int, str, int, int]] = []  # pos, tag, first piece, first raw
        self.headed: set[int | None] = set()  # parents that have had a heading child
        self.following: set[int] = set()  # elements with a heading before them among siblings
        self.pieces: list[str] = []
        self.raws: list[str] = []
        self.children: list[list] = []  # per element: up to two children (row number or text)

    def add_child(self, child) -> None:
        if self.open and len(self.children[self.open[-1][0]]) < 2:
            self.children[self.open[-1][0]].append(child)

    def text(self, value: str) -> None:
        if not value:
            return
        value = _unescape(value)
        self.add_child(value)
        self.raws.append(value)
        if bare := value.strip():
            self.pieces.append(bare)

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        while self.implied_ends and self.open and tag in IMPLIED_END.get(self.open[-1][1], ()):
            self.close_top()
        pos = len(self.rows)
        self.add_child(pos)
        parent = self.open[-1][0] if self.open else None
        if tag in HEADING_TAGS:
            self.headed.add(parent)
        elif parent in self.headed:
            self.following.add(pos)
        self.rows.append(
            {
                "pos": pos, "last": pos, "parent": parent, "tag": tag, "attrs": attrs,
                "text": None, "raw": None, "single": None,
            }
        )
        self.children.append([])
        self.open.append((pos, tag, len(self.pieces), len(self.raws)))
        if tag in VOID_TAGS:
            self.close_top()

    def end(self, tag: str) -> None:
        rank = CLOSE_RANK.get(tag, 0)
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][1]
            if name == tag:
                while len(self.open) > depth:
                    self.close_top()
                return
            if self.implied_ends and CLOSE_RANK.get(name, 0) > rank:
                return

    def close_top(self) -> None:
        pos, tag, piece, raw = self.open.pop()
        row = self.rows[pos]
        row["last"] = len(self.rows) - 1
        if tag in TEXT_TAGS or pos in self.following:
            row["text"] = "".join(self.pieces[piece:])
        if tag in RAW_TEXT_TAGS:
            row["raw"] = "".join(self.raws[raw:])
            only = self.children[pos]
            if len(only) == 1:
                row["single"] = only[0] if isinstance(only[0], str) else self._single(only[0])

    def _single(self, pos: int) -> str | None:
        children = self.children[pos]
        while len(children) == 1:
            if isinstance(children[0], str):
                return children[0]
            children = self.children[children[0]]
        return None


def parse_elements(
    source: str | None, wanted: frozenset[str] | None = None, implied_ends: bool = True
) -> list[dict]:
    """Elements of one page; ``wanted`` limits which tags are returned."""
    page = _Page(implied_ends)
    at, size = 0, len(source or "")
    while at < size:
        token = TOKEN.search(source, at)
        if token is None:
            page.text(source[at:])
            break
        page.text(source[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token[0].startswith("<!--"):
                page.add_child("")
            continue
        tag = tag.lower()
        if token["end"]:
            page.end(tag)
            continue
        page.start(tag, _attributes(token["attrs"]))
        if tag in OPAQUE_TAGS:
            stop = re.compile(f"</{tag}", re.IGNORECASE).search(source, at)
            at = stop.start() if stop else size
    while page.open:
        page.close_top()
    for row in page.rows:
        row["parent_last"] = None if row["parent"] is None else page.rows[row["parent"]]["last"]
    return [r for r in page.rows if wanted is None or r["tag"] in wanted]


def _offsets(lists: Iterable[Sequence]) -> pa.Array:
    return pa.array([0, *accumulate(len(x) for x in lists)], pa.int32())


def element_columns(rows: Sequence[dict]) -> list[pa.Array]:
    """Elements as Arrow columns in the order of :data:`ELEMENT_FIELDS`."""
    attrs = [r["attrs"] for r in rows]
    pairs = list(chain.from_iterable(attrs))
    return [
        *(pa.array([r[name] for r in rows], pa.int32()) for name in ("pos", "last", "parent", "parent_last")),
        pa.array([r["tag"] for r in rows], pa.string()),
        pa.MapArray.from_arrays(
            _offsets(attrs),
            pa.array([k for k, _ in pairs], pa.string()),
            pa.array([v for _, v in pairs], pa.string()),
        ),
        *(pa.array([r[name] for r in rows], pa.string()) for name in ("text", "raw", "single")),
    ]


def element_batches(
    batches: Iterable[pa.RecordBatch], wanted: frozenset[str] | None, implied_ends: bool = True
) -> Iterator[pa.RecordBatch]:
    """Elements of batches ``(page_id, html)``, given out whenever a few pages are parsed.

    What a task holds as Python objects is bounded by :data:`SLICE_CHARS` and one page, however
    many pages there are in a batch.
    """
    for batch in batches:
        owners, rows, chars = [], [], 0
        for n, source in enumerate(batch.column(1)):
            source = source.as_py()
            found = parse_elements(source, wanted, implied_ends)
            owners.extend([n] * len(found))
            rows.extend(found)
            chars += len(source or "")
            if chars >= SLICE_CHARS or n + 1 == batch.num_rows:
                keys = batch.column(0).take(pa.array(owners, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, *element_columns(rows)], names=["page_id", *ELEMENT_FIELDS])
                owners, rows, chars = [], [], 0


def element_table(
    pages: DataFrame,
    tags: Sequence[str] | None = None,
    cluster: bool = False,
    implied_ends: bool = True,
) -> DataFrame:
    """Rows ``(page_id, pos, last, parent, parent_last, tag, attrs, text, raw, single)``.

    Elements are numbered in document order and ``last`` is the number of an element's last
    descendant, so element ``a`` holds ``b`` where ``a.pos < b.pos <= a.last``; a row stays as
    small at any depth. ``parent_last`` is the same of its parent.

    ``text`` strips every text node and joins the rest without a separator; ``raw``
    is the unstripped text (headings and code only); ``single`` is the text of an
    element whose only content is one text node.  Containers such as ``body`` have no
    text of their own unless they follow a heading.  ``tags`` drops other elements
    right in the parser.  ``cluster`` shuffles by page, for callers that use windows
    per page; aggregations per page combine before their own shuffle instead.  With
    ``implied_ends=False`` only end tags close elements, which is the rule for the
    numbered-risk pages.
    """
    wanted = None if tags is None else frozenset(tags)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return element_batches(batches, wanted, implied_ends)

    source = pages.select("page_id", "html")
    key = source.schema["page_id"].dataType.simpleString()
    rows = source.mapInArrow(parse, ", ".join([f"page_id {key}", *(f"{name} {kind}" for name, kind in ELEMENT_FIELDS.items())]))
    return rows.repartition("page_id") if cluster else rows
