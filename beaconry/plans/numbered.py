"""Numbered-risk documents ("A01 ... A10"): markdown, link lists, HTML, fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.text import strip, strip_bullet
from beaconry.functions.urls import risk_label_title, risk_number
from beaconry.operators import lines as ln
from beaconry.operators import sections as sec
from beaconry.session import materialise

RISK_TYPE = (
    "source_id string, risk_id string, risk_no int, title string, severity string, icon string, "
    "description string, types array<struct<name:string,descr:string>>, impacts array<string>, "
    "mitigations array<string>, examples array<string>"
)
COLUMNS = [part.split()[0] for part in RISK_TYPE.split(", ")]


def _shaped(rows: DataFrame, *others: str) -> DataFrame:
    """Fill the columns a parser does not produce; ``others`` stay too."""
    fills = {
        "severity": F.lit(fixed.DEFAULT_SEVERITY),
        "icon": F.lit(fixed.DEFAULT_RISK_ICON),
        "types": F.array().cast("array<struct<name:string,descr:string>>"),
        **{k: F.array().cast("array<string>") for k in ("impacts", "mitigations", "examples")},
    }
    for name, value in fills.items():
        rows = rows.withColumn(name, F.coalesce(name, value) if name in rows.columns else value)
    return rows.select(*COLUMNS, *others)


def _last_at_first_place(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row per key, numbered by the key's first place."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    picked = rows.groupBy(*keys).agg(
        F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("_row")
    )
    return picked.select(*keys, order, "_row.*")


def risks_from_markdown(sources: DataFrame) -> DataFrame:
    """Risks of ``(source_id, markdown)`` texts split at their numbered headings."""
    heading = F.lit(f"(?Umd){fixed.RISK_HEADING}")
    split = sources.select("source_id", "markdown").repartition("source_id").select(
        "source_id",
        F.arrays_zip(
            F.regexp_extract_all("markdown", heading, F.lit(1)).alias("risk_id"),
            F.regexp_extract_all("markdown", heading, F.lit(2)).alias("title"),
            F.slice(
                F.split("markdown", f"(?Umd){fixed.RISK_HEADING}"), 2, 2**31 - 1
            ).alias("body"),
        ).alias("parts"),
    )
    parts = split.select("source_id", F.posexplode("parts").alias("risk_no", "part")).select(
        "source_id",
        "risk_no",
        F.col("part.risk_id").alias("risk_id"),
        strip(F.col("part.title")).alias("title"),
        F.filter(
            F.transform(F.split("part.body", ln.LINE_END), strip), lambda line: line != ""
        ).alias("body"),
    )
    keys = ["source_id", "risk_no", "risk_id", "title"]
    # The first line is the description; only the lines after it open or fill buckets.
    lines = parts.select(*keys, F.posexplode_outer("body").alias("pos", "first")).withColumn(
        "line", F.when(F.col("pos") > 0, F.col("first"))
    )
    bucketed = ln.bucket_marks(lines, ["source_id", "risk_no"])
    entry = F.struct("pos", strip_bullet(F.col("line")).alias("line"))
    names = ("impacts", "mitigations", "examples", "types")
    rows = bucketed.groupBy(*keys).agg(
        F.coalesce(F.min_by("first", "pos"), F.lit("")).alias("description"),
        *[
            F.array_sort(F.collect_list(F.when(F.col("bucket") == name, entry)))
            .getField("line")
            .alias(name)
            for name in names
        ],
    )
    typed = rows.withColumn("types", ln.as_types(F.col("types")))
    return _shaped(_last_at_first_place(typed, ["source_id", "risk_id"], "risk_no"))


#: Levels at which a source may give its risks; the least one that gives any counts.
STATIC, MARKDOWN, DETAIL, HEADING, ENTRY = range(5)


def risk_candidates(
    elements: DataFrame, site: str = "", pattern: str = fixed.RISK_LABEL
) -> DataFrame:
    """Links, headings and list entries that name a risk, in one pass over the elements.

    ``(page_id, level, risk_id, risk_no, title, description, url)``, one row per page, level
    and id: the last link or heading of an id wins, the first list entry does. ``risk_no`` is
    the number of a link, else the id's first place; headings carry the next sibling ``p``.
    """
    tag, text = F.col("tag"), F.col("text")
    href = F.col("attrs")["href"]
    link_id = F.when(tag == "a", F.nullif(F.regexp_extract(href, fixed.RISK_HREF, 1), F.lit("")))
    slug = F.replace(F.regexp_extract(href, fixed.RISK_HREF, 2), F.lit("_"), F.lit(" "))
    label_id = F.when(tag != "p", risk_number(text, pattern))
    next_p = F.min(F.when(tag == "p", F.struct("pos", "text"))).over(_siblings_after())
    level = (
        F.when(link_id.isNotNull(), DETAIL)
        .when(tag.isin("h2", "h3") & label_id.isNotNull(), HEADING)
        .when((tag == "li") & label_id.isNotNull(), ENTRY)
    )
    is_link, is_heading = tag == "a", tag.isin("h2", "h3")
    fields = {
        "title": F.when(~is_link, risk_label_title(text, pattern)).when(text == "", slug).otherwise(text),
        "description": F.when(is_heading, F.coalesce("next_p.text", F.lit(""))).otherwise(F.lit("")),
        "url": F.when(is_link, F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))),
    }
    named = (
        elements.filter("tag in ('a', 'h2', 'h3', 'p', 'li')")
        .withColumn("next_p", next_p)
        .select(
            "page_id", "pos", level.alias("level"), F.coalesce(link_id, label_id).alias("risk_id"),
            F.struct(*[value.alias(name) for name, value in fields.items()]).alias("_row"),
        )
        .filter("level is not null")
    )
    chosen = F.when(F.col("level") == ENTRY, F.min_by("_row", "pos")).otherwise(F.max_by("_row", "pos"))
    place = F.when(F.col("level") == DETAIL, F.substring("risk_id", 2, 2).cast("int")).otherwise(F.min("pos"))
    return named.groupBy("page_id", "level", "risk_id").agg(
        place.alias("risk_no"), chosen.alias("_row")
    ).select("page_id", "level", "risk_id", "risk_no", "_row.*")


def _of_level(candidates: DataFrame, level: int) -> DataFrame:
    return candidates.filter(F.col("level") == level).withColumn(
        "source_id", F.col("page_id").cast("string")
    )


def risk_links(elements: DataFrame, site: str) -> DataFrame:
    """Detail links ``(page_id, risk_id, title, url)``; the last link of an id wins."""
    found = risk_candidates(elements.filter("tag = 'a'"), site)
    return _of_level(found, DETAIL).select("page_id", "risk_id", "title", "url")


def risk_headings(elements: DataFrame, pattern: str = fixed.RISK_LABEL) -> DataFrame:
    """Numbered h2/h3 headings with the next sibling ``p``; last heading of an id wins."""
    found = risk_candidates(elements.filter("tag in ('h2', 'h3', 'p')"), pattern=pattern)
    return _shaped(_of_level(found, HEADING))


def risk_list_entries(elements: DataFrame, pattern: str = fixed.RISK_LABEL) -> DataFrame:
    """Numbered ``li`` entries; the first entry of an id wins."""
    found = risk_candidates(elements.filter("tag = 'li'"), pattern=pattern)
    return _shaped(_of_level(found, ENTRY))


def risk_page_markdown(
    pages: DataFrame,
    keys: Sequence[str],
    pattern: str = r"^#{2,4}\s+(.+)$",
    words: Mapping[str, Sequence[str]] = fixed.MARKDOWN_KEYS,
) -> DataFrame:
    """Description and lists of single-risk ``markdown`` pages, one row per key."""
    lines = ln.line_table(pages, keys, "markdown", ln.LINE_END)
    buckets = ln.header_buckets(ln.heading_fill(lines, keys, pattern), keys)
    grouped = ln.headers_per_key(buckets, keys)
    headers = F.col("headers")
    named = [ln.header_lines(headers, h) for h in [*fixed.DESCRIPTION_HEADERS, "body"]]
    lists = ln.collect_all(headers, words, clean=True)
    return grouped.select(
        *keys,
        F.coalesce(*named, F.lit("")).alias("description"),
        *[value.alias(name) for name, value in lists.items()],
    )


def risk_page_html(elements: DataFrame) -> DataFrame:
    """The same from the elements of single-risk pages, keyed by ``page_id``, in one pass.

    Lists under a heading are number ranges of their page, attached to its rows by a window; an
    entry belongs to every range that holds it.
    """
    tag, page = F.col("tag"), Window.partitionBy("page_id")
    owned = F.col("h23").isNotNull() & ~tag.isin("h2", "h3")
    head = F.struct(F.col("h23.pos").alias("head_pos"), F.lower("h23.text").alias("header"))
    range_ = F.struct("pos", "last", head.alias("h"))
    line = F.struct(head.alias("h"), F.col("pos").alias("root_pos"), "pos", "text")
    entries = F.transform(
        sec.holders(F.col("ranges"), F.col("pos")),
        lambda r: F.struct(r["h"].alias("h"), r["pos"].alias("root_pos"), F.col("pos"), F.col("text")),
    )
    none = F.filter(F.array(line), lambda _: F.lit(False))
    rows = (
        sec.sibling_marks(elements)
        .withColumn("ranges", F.collect_list(F.when(owned & tag.isin("ul", "ol"), range_)).over(page))
        .select(
            "page_id",
            F.when(tag == "p", F.struct("pos", "text")).alias("p"),
            F.when(owned & (tag == "p"), F.array(line)).when(tag == "li", entries).otherwise(none).alias("lines"),
        )
        .select("page_id", "p", F.explode_outer("lines").alias("line"))
    )
    parts = rows.groupBy("page_id", "line.h").agg(
        F.min("p").alias("p"),
        F.array_sort(F.collect_list(F.struct("line.root_pos", "line.pos", "line.text"))).getField("text").alias("texts"),
    )
    # As of repeated headings the last one with lines counts, at the first one's place.
    filled = F.col("h").isNotNull() & (F.size("texts") > 0)
    by_name = parts.groupBy("page_id", F.col("h.header").alias("header")).agg(
        F.min("p").alias("p"),
        F.min(F.when(filled, F.col("h.head_pos"))).alias("first_pos"),
        F.max_by("texts", F.when(filled, F.col("h.head_pos"))).alias("lines"),
    )
    named = F.when(F.col("first_pos").isNotNull(), F.struct("first_pos", "header", "lines"))
    pages = by_name.groupBy("page_id").agg(
        F.min("p").alias("p"), F.array_sort(F.collect_list(named)).alias("headers")
    )
    collected = ln.collect_all(F.col("headers"), fixed.HTML_KEYS, clean=False)
    return pages.select(
        "page_id",
        F.coalesce("p.text", F.lit("")).alias("description"),
        *[value.alias(name) for name, value in collected.items()],
    )


def _siblings_after():
    return Window.partitionBy("page_id", "parent").orderBy("pos").rowsBetween(
        1, Window.unboundedFollowing
    )


def detail_enrich(links: DataFrame, details: DataFrame, elements: DataFrame) -> DataFrame:
    """Links joined to their fetched detail pages; markdown first, HTML if it says nothing.

    ``links`` are ``(page_id, risk_id, title, url)``; ``details`` are scrape records.
    Failed fetches drop their link.  One detail page per URL (the newest) is used, and
    HTML is read only for pages whose markdown gave no description.  What the markdown
    gives is a table in the shared folder, so neither text is parsed twice.
    """
    fetched = details.filter("success")
    newest = fetched.groupBy("url").agg(F.max("page_id").alias("detail_id"))
    asked = newest.join(links.select("url").distinct(), "url", "left_semi")
    bodies = fetched.select(
        F.col("page_id").alias("detail_id"), "url", F.coalesce("markdown", F.lit("")).alias("markdown")
    ).join(asked, ["detail_id", "url"], "left_semi")
    texts = risk_page_markdown(bodies, ["detail_id", "url"])
    described = materialise(asked.join(texts, ["detail_id", "url"], "left"), "risk-details")
    empty = described.filter("coalesce(description, '') = ''").select("detail_id", "url")
    html = risk_page_html(
        elements.join(empty.select(F.col("detail_id").alias("page_id")), "page_id", "left_semi")
    ).withColumnRenamed("page_id", "detail_id")
    parsed = described.filter("description != ''").unionByName(empty.join(html, "detail_id"))
    return _shaped(
        links.join(parsed, "url").select(
            F.col("page_id").cast("string").alias("source_id"),
            "risk_id",
            F.substring("risk_id", 2, 2).cast("int").alias("risk_no"),
            "title",
            *[c for c in parsed.columns if c not in ("detail_id", "url")],
        )
    )


def fallback_chain(keys: Sequence[str], *levels: DataFrame) -> DataFrame:
    """Rows of the first level that has any for the key; later levels fill the gaps."""
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level.join(out.select(*keys).distinct(), list(keys), "left_anti"))
    return out


def elected(candidates: DataFrame, key: str = "source_id", level: str = "level") -> DataFrame:
    """All rows of the least level each key has, by one aggregate; rows of one key are one page's."""
    rest = [c for c in candidates.columns if c not in (key, level)]
    row = F.struct(*rest)
    lists = [F.collect_list(F.when(F.col(level) == n, row)).alias(f"_{n}") for n in range(ENTRY + 1)]
    first = F.coalesce(*[F.when(F.size(f"_{n}") > 0, F.col(f"_{n}")) for n in range(ENTRY + 1)])
    return candidates.groupBy(key).agg(*lists).select(key, F.inline(first))


def risks_of_sources(
    scraped: DataFrame,
    elements: DataFrame,
    details: DataFrame,
    detail_elements: DataFrame,
    site: str,
    static: DataFrame | None = None,
) -> DataFrame:
    """Risk set per source page: markdown, else linked detail pages, else headings, else lists.

    Parse both element tables with ``implied_ends=False``. Each is read once: one pass gives
    the candidates of all page levels, which join the markdown's in a table in the shared
    folder; detail pages are read for sources whose least level is their links. One aggregate
    then keeps the least level that gave any risk. Sources in ``static`` use its rows.
    """
    ids = scraped.filter("success").select(
        F.col("page_id").cast("string").alias("source_id"), "page_id",
        F.coalesce("markdown", F.lit("")).alias("markdown"),
    )
    pages = elements.join(ids.select("page_id"), "page_id", "left_semi")
    found = risk_candidates(pages, site).withColumn("source_id", F.col("page_id").cast("string"))
    url = F.lit(None).cast("string").alias("url")
    levels = [(MARKDOWN, risks_from_markdown(ids)), *([(STATIC, _shaped(static))] if static is not None else [])]
    candidates = _shaped(found, "level", "url")
    for level, risks in levels:
        candidates = candidates.unionByName(risks.select("*", F.lit(level).alias("level"), url))
    stored = materialise(candidates, "risk-candidates")
    least = stored.groupBy("source_id").agg(F.min("level").alias("least")).filter(F.col("least") == DETAIL)
    links = stored.filter(F.col("level") == DETAIL).join(least, "source_id", "left_semi").select(
        F.col("source_id").alias("page_id"), "risk_id", "title", "url"
    )
    enriched = detail_enrich(links, details, detail_elements).withColumn("level", F.lit(DETAIL))
    others = stored.filter(F.col("level") != DETAIL).drop("url")
    return elected(others.unionByName(enriched)).select(*COLUMNS)


def list_rows(risks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every list of a risk as rows ``(keys, part, n, line)`` in order; ``part`` is null for a risk without lists."""
    parts = {"types": F.transform("types", lambda t: t["name"]), **{c: F.col(c) for c in ("impacts", "mitigations", "examples")}}

    def numbered_lines(part: str, lines: Column) -> Column:
        return F.transform(
            lines, lambda x, i: F.struct(F.lit(part).alias("part"), (i + 1).alias("n"), x.alias("line"))
        )

    lines = F.concat(*[numbered_lines(part, value) for part, value in parts.items() if part in risks.columns])
    return risks.select(*keys, F.inline_outer(lines))
