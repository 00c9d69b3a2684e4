"""Main text of web pages by scoring the element tree.

Paragraphs earn points for length and commas and pass them on to their ancestors, less with every level; a
container's points are discounted by the share of its text that stands in links. The best container and
the siblings that belong to it are kept, without menus, headers, forms and the like.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul br".split()
)
#: Elements whose text is never part of an article.
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object svg math canvas audio "
    "video menu dialog input label".split()
)
#: Words of class, id or role that name things beside the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments complementary "
    "consent contentinfo cookie cookies copyright disqus footer gdpr header hidden login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended "
    "related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe teaser "
    "toolbar tooltip widget widgets alert alerts".split()
)
#: These stay, whatever their class says.
FRAME = frozenset("html body main article".split())
PARAGRAPH = frozenset("p pre td blockquote li dd div section h2 h3".split())
PRIOR = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "body": 0.0, "ul": -3.0, "ol": -3.0, "li": -3.0}
HEADINGS = frozenset("h1 h2 h3".split())
#: Inside an article or main element these stay, whatever their class says.
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LEAST_PARAGRAPH = 25
LEVELS = 5
#: A list or box of at least so many links is a menu where links are more than this share of its text.
MENU_LINKS, MENU_SHARE = 3, 0.8
#: A start tag of the key ends an open element of the value, inside the nearest of the listed holders.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*").findall


class Tree(HTMLParser):
    """Elements in page order (a parent before its children), and text parts with the element they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.aside = ["#root"], [-1], [False]
        self.open, self.parts = [0], []
        #: How many elements of each tag are open.
        self.depth = Counter(["#root"])

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.parts.append((self.open[-1], None))
            if tag != "br":
                self._end_within("p", frozenset(["table", "button", "td", "th"]))
        if tag in ENDS:
            closes, holders = ENDS[tag]
            for name in closes:
                self._end_within(name, holders)
        if tag in VOID:
            return
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.aside.append(self._is_aside(tag, attrs))
        self.open.append(len(self.tags) - 1)
        self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.parts.append((self.open[-1], None))
        self._end_within(tag, frozenset())

    def handle_data(self, data):
        self.parts.append((self.open[-1], data))

    def _end_within(self, tag, holders):
        # Most end tags that are implied have nothing to end: no walk through deep pages for these.
        if not self.depth[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tags[self.open[depth]]
            if name == tag:
                self.depth.subtract(self.tags[i] for i in self.open[depth:])
                del self.open[depth:]
                return
            if name in holders:
                return

    def _is_aside(self, tag, attrs) -> bool:
        if tag in NEVER:
            return True
        inside = self.depth["article"] or self.depth["main"]
        if tag == "header":
            return not inside
        # A heading of the article is named after its look as often as after its place.
        if tag in FRAME or inside and tag in TITLES:
            return False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                if any(w.lower() in ASIDE_WORDS for w in _WORDS(value)):
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


def extract(html: str) -> str:
    tree = parse(html)
    n, tags, parents = len(tree.tags), tree.tags, tree.parents
    aside, linked = list(tree.aside), [t == "a" for t in tags]
    for i in range(1, n):
        aside[i] = aside[i] or aside[parents[i]]
        linked[i] = linked[i] or linked[parents[i]]

    chars, link_chars, own, commas, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i, text in tree.parts:
        if text and not aside[i]:
            size = len(text.strip())
            chars[i] += size
            link_chars[i] += size * linked[i]
    block = [i if tags[i] in BLOCK or i == 0 else -1 for i in range(n)]
    for i in range(1, n):
        if block[i] < 0:
            block[i] = block[parents[i]]
    for i, text in tree.parts:
        if text and not aside[i]:
            own[block[i]] += len(text.strip())
            commas[block[i]] += text.count(",") + text.count("，") + text.count("、")
    for i in range(n - 1, 0, -1):
        links[i] += tags[i] == "a"
        for sums in (chars, link_chars, links):
            sums[parents[i]] += sums[i]
    share = [link_chars[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    for i in range(1, n):
        menu = tags[i] in ("ul", "ol", "div", "section", "table") and links[i] >= MENU_LINKS and share[i] > MENU_SHARE
        aside[i] = aside[i] or menu or aside[parents[i]]

    points = [0.0] * n
    for i in range(1, n):
        if tags[i] in PARAGRAPH and own[i] >= LEAST_PARAGRAPH and not aside[i]:
            gain, up = 1.0 + commas[i] + min(own[i] / 100, 3.0), parents[i]
            for level in range(LEVELS):
                if up <= 0:
                    break
                points[up] += gain / (1, 2, 6, 9, 12)[level]
                up = parents[up]
    scored = [
        ((points[i] + PRIOR.get(tags[i], 0.0)) * (1 - share[i]), -i)
        for i in range(1, n)
        if not aside[i] and chars[i] and (points[i] or tags[i] in ("article", "main", "body"))
    ]
    if scored:
        top, best = max(scored)
        best = -best
    else:
        top, best = 0.0, 0
    roots = _with_siblings(best, top, tags, parents, aside, chars, share, points)

    kept = [i in roots for i in range(n)]
    for i in range(1, n):
        kept[i] = (kept[i] or kept[parents[i]]) and not aside[i]
    return " ".join("".join(" " if text is None else text for i, text in tree.parts if text is None or kept[i]).split())


def _with_siblings(best, top, tags, parents, aside, chars, share, points) -> set[int]:
    """The best container, or the article it is a part of, and siblings that go with it."""
    up = best
    while up > 0:
        if tags[up] in ("article", "main"):
            best = up
            if tags[up] == "article":
                break
        up = parents[up]
    roots = {best}
    if best > 0 and tags[best] not in FRAME:
        for i in range(parents[best] + 1, len(tags)):
            if parents[i] == parents[best] and not aside[i]:
                goes = points[i] * (1 - share[i]) >= max(10.0, 0.2 * top)
                goes = goes or tags[i] == "p" and chars[i] and share[i] < 0.25 or tags[i] in HEADINGS
                if goes:
                    roots.add(i)
    return roots


def articles(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page has the empty text, as has one without any text outside of menus and the like; broken
    markup is read as far as it goes. Nulls in page_id and url and repeated rows are kept, an empty table gives
    no row, other columns are not looked at.
    """

    def apply(batches):
        for batch in slices(batches, text=2):
            text = pa.array([extract(h) if h else "" for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["page_id", "url", "text"])

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = named.mapInArrow(apply, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
