"""Risk sources over the given pages: links, headings, details and the choice of a level per source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.operators import sections as sec
from beaconry.plans import numbered
from beaconry.sources.html_elements import element_table
from workload.page_queries import SQL_PARAGRAPHS
from workload.registry import query, table

SITE = "https://guides.example.org"


def _spliced(page: Column, before_article: Column, in_article: Column) -> Column:
    """The page with its unclosed elements closed and parts put before and into its article."""
    closed = F.replace(F.replace(page, F.lit("<p><b>"), F.lit("<p>")), F.lit("<br><p>"), F.lit("</p><p>"))
    return F.replace(closed, F.lit("<article>"), F.concat(before_article, F.lit("<article>"), in_article))


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _linked(spark, sf, links_if: Column, headed_if: Column, listed_if: Column):
    """Pages with risk links, numbered headings and numbered list entries where the conditions hold."""
    n = F.col("page_id") % 9
    links = _text(
        "<a href='/Top10/2025/A0", n, "_2025-Old_", F.col("page_id"), "/'>Old name</a>",
        "<a href='/Top10/2025/A0", n, "_2025-Page_", F.col("page_id"), "/'></a>",
        "<a href='https://else.example/Top10/2025/A10_2025-Last/'>Last ", F.col("page_id"), "</a>",
    )
    heads = _text("<h2>A", n, ": First</h2><h2>A0", n, " - Page ", F.col("page_id"), "</h2>")
    entries = _text("<ul><li>A", n, " – Entry ", F.col("page_id"), "</li><li>A0", n, ": Again</li></ul>")
    none = F.lit("")
    before = F.concat(F.when(links_if, links).otherwise(none), F.when(listed_if, entries).otherwise(none))
    html = _spliced(F.col("html"), before, F.when(headed_if, heads).otherwise(none))
    return _pages(spark, sf).withColumn("html", html)


@query(
    "risk_links",
    f"""
    SELECT page_id, 'A0' || (page_id % 9) AS risk_id, 'Page ' || page_id AS title,
        '{SITE}/Top10/2025/A0' || (page_id % 9) || '_2025-Page_' || page_id || '/' AS url FROM pages
    UNION ALL SELECT page_id, 'A10', 'Last ' || page_id, 'https://else.example/Top10/2025/A10_2025-Last/' FROM pages
    """,
)
def risk_links(spark, sf):
    """Detail links of every page: the last of an id wins, an empty text gives way to the slug."""
    yes = F.lit(True)
    return numbered.risk_links(element_table(_linked(spark, sf, yes, yes, yes), implied_ends=False), SITE)


@query(
    "risk_headings",
    f"""
    SELECT cast(p.page_id AS VARCHAR) AS source_id, 'A0' || (p.page_id % 9) AS risk_id, 'Page ' || p.page_id AS title, coalesce(text, '') AS description
    FROM pages p LEFT JOIN (SELECT * FROM ({SQL_PARAGRAPHS}) WHERE n = 1) f USING (page_id)
    """,
)
def risk_headings(spark, sf):
    """Numbered headings of every page with the paragraph after them."""
    yes = F.lit(True)
    elements = element_table(_linked(spark, sf, yes, yes, yes), implied_ends=False)
    return numbered.risk_headings(elements).select("source_id", "risk_id", "title", "description")


#: Paragraphs of a page without repeats, numbered by first place.
SQL_DISTINCT = f"""
    SELECT page_id, text AS line, row_number() OVER (PARTITION BY page_id ORDER BY n) AS n
    FROM (SELECT page_id, text, min(n) AS n FROM ({SQL_PARAGRAPHS}) WHERE text <> '' GROUP BY 1, 2)
"""


def _details(spark, sf):
    """A fetched page per given page; every second has a markdown text that says enough, every fifth failed."""
    markdown = _text("# Page\n## Description\nAbout ", F.col("page_id"), "\n### Impact\n- loss ", F.col("page_id"), "\n* more\n")
    lists = _text(
        "<h2>Impact</h2><ul><li>page ", F.col("page_id"), "</li><li>all<ul><li>inner</li></ul></li></ul><h3>How to prevent</h3>"
    )
    return _pages(spark, sf).select(
        "page_id",
        _text(SITE, "/Top10/2025/A0", F.col("page_id") % 9, "_2025-Page_", F.col("page_id"), "/").alias("url"),
        (F.col("page_id") % 5 != 4).alias("success"),
        _spliced(F.col("html"), F.lit(""), lists).alias("html"),
        F.when(F.col("page_id") % 2 == 0, markdown).otherwise(F.lit("## Impact\n\n### Overview\n")).alias("markdown"),
    )


SQL_DETAIL_LISTS = f"""
    SELECT page_id, 'impacts' AS part, 1 AS n, CASE WHEN page_id % 2 = 0 THEN 'loss ' || page_id ELSE 'page ' || page_id END AS line FROM pages
    UNION ALL SELECT page_id, 'impacts', 2, CASE WHEN page_id % 2 = 0 THEN 'more' ELSE 'allinner' END FROM pages
    UNION ALL SELECT page_id, 'impacts', 3, 'inner' FROM pages WHERE page_id % 2 = 1
    UNION ALL SELECT page_id, 'mitigations', n, line FROM ({SQL_DISTINCT}) WHERE page_id % 2 = 1
"""


def _shown(risks):
    rows = numbered.list_rows(risks, ["source_id", "risk_id", "title", "description"])
    return rows.withColumn("n", F.col("n").cast("bigint"))


@query(
    "detail_enrich",
    f"""
    SELECT cast(p.page_id AS VARCHAR) AS source_id, 'A0' || (p.page_id % 9) AS risk_id, 'Page ' || p.page_id AS title,
        CASE WHEN p.page_id % 2 = 0 THEN 'About ' || p.page_id ELSE coalesce(f.text, '') END AS description, part, l.n, line
    FROM pages p JOIN ({SQL_DETAIL_LISTS}) l USING (page_id)
    LEFT JOIN (SELECT * FROM ({SQL_PARAGRAPHS}) WHERE n = 1) f ON f.page_id = p.page_id WHERE p.page_id % 5 <> 4
    """,
)
def detail_enrich(spark, sf):
    """Links with what their detail pages say: the markdown, or the HTML where it gives no description."""
    yes = F.lit(True)
    details = _details(spark, sf)
    links = numbered.risk_links(element_table(_linked(spark, sf, yes, yes, yes), implied_ends=False), SITE)
    return _shown(numbered.detail_enrich(links, details, element_table(details, implied_ends=False)))


@query(
    "risks_of_sources",
    f"""
    WITH p AS (SELECT *, page_id % 6 AS kind, 'A0' || (page_id % 9) AS id FROM pages WHERE page_id % 7 <> 6),
    f AS (SELECT page_id, text FROM ({SQL_PARAGRAPHS}) WHERE n = 1)
    SELECT cast(page_id AS VARCHAR) AS source_id, id AS risk_id, 'Kept ' || url AS title, 'Text ' || page_id AS description,
        'mitigations' AS part, n, CASE n WHEN 1 THEN 'patch ' || page_id ELSE 'watch' END AS line FROM p, (SELECT unnest([1, 2]) AS n) WHERE kind = 0
    UNION ALL SELECT cast(p.page_id AS VARCHAR), id, 'Page ' || p.page_id, CASE WHEN p.page_id % 2 = 0 THEN 'About ' || p.page_id ELSE coalesce(text, '') END,
        part, n, line FROM p JOIN ({SQL_DETAIL_LISTS}) l USING (page_id) LEFT JOIN f ON f.page_id = p.page_id WHERE kind IN (1, 2) AND p.page_id % 5 <> 4
    UNION ALL SELECT cast(p.page_id AS VARCHAR), id, 'Page ' || p.page_id, coalesce(text, ''), NULL, NULL, NULL FROM p LEFT JOIN f ON f.page_id = p.page_id
        WHERE kind = 3 OR kind IN (1, 2) AND p.page_id % 5 = 4
    UNION ALL SELECT cast(page_id AS VARCHAR), id, 'Entry ' || page_id, '', NULL, NULL, NULL FROM p WHERE kind = 4
    """,
)
def risks_of_sources(spark, sf):
    """Every level at work: markdown, links to detail pages, headings (also where the details failed), list entries, nothing."""
    kind = F.col("page_id") % 6
    markdown = _text(
        "# A0", F.col("page_id") % 9, ": Kept ", F.col("url"), "\nText ", F.col("page_id"),
        "\nPrevention\n- patch ", F.col("page_id"), "\n- watch\n",
    )
    pages = _linked(spark, sf, kind.isin(0, 1, 2), kind.isin(0, 1, 2, 3), kind < 5)
    scraped = pages.select(
        "*", (F.col("page_id") % 7 != 6).alias("success"), F.when(kind == 0, markdown).otherwise(F.lit("")).alias("markdown")
    )
    details = _details(spark, sf)
    found = numbered.risks_of_sources(
        scraped, element_table(scraped, implied_ends=False), details, element_table(details, implied_ends=False), SITE
    )
    return _shown(found)


@query(
    "contributors",
    """
    SELECT page_id, cast(i AS BIGINT) AS n, 'Name ' || page_id || '.' || i AS name FROM pages, (SELECT unnest(range(1, 11)) AS i) WHERE i <= page_id % 13
    """,
)
def contributors(spark, sf):
    """Names listed right after an author heading: ten at most, entries of other lists left out."""
    names = F.transform(
        F.sequence(F.lit(0), F.col("page_id") % 13), lambda i: F.when(i > 0, _text("<li>Name ", F.col("page_id"), ".", i, "</li>"))
    )
    lists = _text(
        "<h2>Authors and Primary Editors</h2><div><div><ul>", F.array_join(F.array_compact(names), " "),
        "</ul></div></div><ul><li>Other</li></ul>",
    )
    pages = _pages(spark, sf).withColumn("html", _spliced(F.col("html"), F.lit(""), lists))
    found = sec.contributors(sec.sibling_marks(element_table(pages, cluster=True)))
    named = found.select("page_id", F.posexplode("contributors").alias("n", "name"))
    return named.select("page_id", (F.col("n") + 1).cast("bigint").alias("n"), "name")
