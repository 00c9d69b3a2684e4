"""Element table, links, indexes, headings and sheets over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.urls import host_of, resolve_url
from beaconry.operators import links as lk
from beaconry.operators import sections as sec
from beaconry.operators.firsts import first_per_key, last_per_key
from beaconry.plans import index, numbered, sheets
from beaconry.session import persist_clustered
from beaconry.sources.html_elements import element_table
from beaconry.sources.pages import first_pages, path_filter, read_pages, url_inventory
from workload.registry import query, sql_words, table
from workload.text_queries import SQL_SLUG, sql_category

BASE = "https://guides.example.org"
SQL_ANCHORS = """
    SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
        unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) AS n
    FROM pages
"""
SQL_ORIGIN = "regexp_extract(page_url, '^(https?://[^/?#]*)', 1)"


def sql_unescape(column: str) -> str:
    return (
        f"replace(replace(replace({column}, '&quot;', '\"'), '&middot;', '·'), '&amp;', '&')"
    )


SQL_PARAGRAPHS = f"""
    SELECT page_id, n, trim(regexp_replace(regexp_replace({sql_unescape("regexp_replace(split_part(raw, '</p>', 1), '<[^>]*>', '', 'g')")},
        '^\\s+', ''), '\\s+$', '')) AS text
    FROM (SELECT page_id, unnest(string_split(split_part(split_part(html, '<article>', 2), '</article>', 1), '<p>')) AS raw,
        generate_subscripts(string_split(split_part(split_part(html, '<article>', 2), '</article>', 1), '<p>'), 1) - 1 AS n FROM pages)
    WHERE n > 0
"""
SQL_TITLE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + sql_unescape("regexp_extract(html, '<h1>(.*?)</h1>', 1)")
    + ", '\\s*¶\\s*', ' ', 'g'), '', ''), '(?i)\\s*Cheat\\s*Sheet\\s*$', '', 'g'), '\\s+', ' ', 'g'))"
)


def _pages(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet")


def _links(spark, sf):
    elements = element_table(_pages(spark, sf), tags=["a"])
    return lk.anchors(elements)


@query(
    "element_counts",
    """
    SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag FROM pages)
    GROUP BY 1, 2
    """,
)
def element_counts(spark, sf):
    return element_table(_pages(spark, sf)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "guidance_links",
    f"SELECT page_id, href, text, count(*) AS n FROM ({SQL_ANCHORS}) WHERE regexp_matches(href, '^/t') GROUP BY 1, 2, 3",
)
def guidance_links(spark, sf):
    found = lk.guidance_links(_links(spark, sf), "^/t")
    return found.groupBy("page_id", "href", "text").agg(F.count("*").alias("n"))


@query(
    "loose_links",
    f"""
    SELECT page_id, href, text, count(*) AS n FROM ({SQL_ANCHORS})
    WHERE NOT starts_with(href, '#') AND (contains(lower(href), 'th') OR contains(lower(text), 'th')) GROUP BY 1, 2, 3
    """,
)
def loose_links(spark, sf):
    found = lk.loose_links(_links(spark, sf), "th")
    return found.groupBy("page_id", "href", "text").agg(F.count("*").alias("n"))


@query("link_pattern_filter", f"SELECT href, count(*) AS n FROM ({SQL_ANCHORS}) WHERE regexp_matches(href, '/[a-m][^/]*n') GROUP BY 1")
def link_pattern_filter(spark, sf):
    found = lk.link_pattern_filter(_links(spark, sf), "/[a-m][^/]*n")
    return found.groupBy("href").agg(F.count("*").alias("n"))


@query(
    "resolve_url",
    f"SELECT page_id, href, {SQL_ORIGIN} || href AS url, count(*) AS n FROM ({SQL_ANCHORS}) GROUP BY 1, 2, 3",
)
def resolve_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("page_url"))
    found = _links(spark, sf).join(pages, "page_id")
    url = resolve_url(F.col("page_url"), F.col("href"))
    return found.groupBy("page_id", "href", url.alias("url")).agg(F.count("*").alias("n"))


@query(
    "crawl_pages",
    """
    SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/en')
        AND NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), 'html$') ORDER BY page_id LIMIT 50
    """,
)
def crawl_pages(spark, sf):
    """One crawl over all pages."""
    pages = table(spark, sf, "pages").select(F.lit("all").alias("job_id"), "page_id", "url")
    return first_pages(path_filter(pages, "^/en", "html$"), 50).drop("job_id")


@query(
    "crawl_jobs",
    f"""
    SELECT host AS job_id, page_id, url FROM (SELECT host, page_id, url, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n
        FROM (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, page_id, url FROM pages
              WHERE NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), 'html$'))) WHERE n <= 20
    """,
)
def crawl_jobs(spark, sf):
    """A crawl per host, each with its own limit."""
    pages = table(spark, sf, "pages").withColumn("job_id", host_of(F.col("url")))
    return first_pages(path_filter(pages.select("job_id", "page_id", "url"), None, "html$"), 20, ["job_id"])


@query(
    "url_inventory",
    "SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, count(DISTINCT url) AS urls FROM pages GROUP BY 1",
)
def url_inventory_by_host(spark, sf):
    return url_inventory(table(spark, sf, "pages")).groupBy("host").agg(F.count("*").alias("urls"))


@query(
    "related_edges",
    f"""
    SELECT page_id, rank, related_id FROM (SELECT page_id, related_id, row_number() OVER (PARTITION BY page_id ORDER BY n) AS rank
        FROM (SELECT page_id, lower(replace(regexp_extract(href, '/([^/]+)', 1), '_', '-')) AS related_id, min(n) AS n
              FROM ({SQL_ANCHORS}) GROUP BY 1, 2)) WHERE rank <= 5
    """,
)
def related_edges(spark, sf):
    elements = element_table(_pages(spark, sf), tags=["a"])
    edges = lk.related_edges(elements, "/([^/]+)", 5)
    return edges.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "first_link_per_href",
    f"SELECT href, page_id, text FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, n) AS r FROM ({SQL_ANCHORS})) WHERE r = 1",
)
def first_link_per_href(spark, sf):
    found = _links(spark, sf).select("href", "page_id", "pos", "text")
    return first_per_key(found, ["href"], ["page_id", "pos"]).drop("pos")


@query(
    "heading_sections",
    f"SELECT page_id, count(*) AS body_count, cast(sum(length(text)) AS BIGINT) AS body_chars FROM ({SQL_PARAGRAPHS}) GROUP BY 1",
)
def heading_sections(spark, sf):
    """Paragraphs owned by each h1 through the sibling window."""
    owned = sec.heading_body(element_table(_pages(spark, sf), cluster=True), "h1", "p")
    return owned.select("page_id", "body_count", F.col("body_chars").cast("bigint").alias("body_chars"))


@query(
    "introductions",
    f"""
    SELECT page_id, left(string_agg(text, ' ' ORDER BY n), 1000) AS intro FROM ({SQL_PARAGRAPHS}) WHERE n <= 3 GROUP BY 1
    """,
)
def introductions(spark, sf):
    marked = sec.sibling_marks(element_table(_pages(spark, sf), cluster=True))
    return sec.introductions(marked)


@query(
    "first_paragraphs",
    f"SELECT page_id, text AS description FROM ({SQL_PARAGRAPHS}) WHERE n = 1",
)
def first_paragraphs(spark, sf):
    elements = element_table(_pages(spark, sf), tags=["p", "h2", "h3", "ul", "ol", "li"], cluster=True)
    return numbered.risk_page_html(elements).select("page_id", "description")


@query("sheet_titles", f"SELECT page_id, title, {SQL_SLUG.format('title')} AS id FROM (SELECT page_id, {SQL_TITLE} AS title FROM pages)")
def sheet_titles(spark, sf):
    return sheets.titles(element_table(_pages(spark, sf), tags=["h1", "title", "html"]))


CATEGORY_KEYS = ["tion", "the", "é", "en", "in"]
SQL_INDEX = f"""
    SELECT page_id, n, coalesce(nullif(lower(replace(regexp_extract(href, '^/(th[a-z]+)', 1), '_', '-')), ''), {SQL_SLUG.format("text")}) AS id,
        trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title, '{BASE}' || href AS url,
        {sql_category("lower(trim(text) || ' ' || href)", CATEGORY_KEYS, fixed.CATEGORY_FALLBACKS)} AS category
    FROM ({SQL_ANCHORS}) WHERE regexp_matches(href, '^/[a-z]')
"""
INDEX_PATTERNS = {
    "pattern": "^/[a-z]", "id_pattern": "^/(th[a-z]+)", "category_keys": CATEGORY_KEYS,
}


def _with_languages(pages, href):
    """Pages whose article links one address with two named images, and again without any."""
    link = F.concat(F.lit(f"<p><a href='{href}"), F.col("page_id") % 50, F.lit(".html'>P</a>"))
    images = F.concat(F.lit("<img alt=' Go"), F.col("page_id") % 7, F.lit("'><img alt=''><img alt='Java'></p>"))
    marked = F.concat(F.lit("<article>"), link, images, link, F.lit("</p>"))
    return pages.withColumn("html", F.replace("html", F.lit("<article>"), marked))


@query(
    "languages_by_url",
    f"""
    SELECT page_id, '{BASE}/cheatsheets/P' || (page_id % 50) || '.html' AS url, 'Go' || (page_id % 7) || ', Java' AS languages FROM pages
    """,
)
def languages_by_url(spark, sf):
    """Pages whose article names two languages as images beside a link, and has the link again without any."""
    pages = _with_languages(_pages(spark, sf), "cheatsheets/P")
    elements = element_table(pages, tags=["a", "img", "article", "main"])
    return lk.languages_by_url(elements, F.lit(BASE))


@query(
    "build_index",
    f"""
    SELECT page_id, id, title, url, category, NULL AS languages FROM
        (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY n) AS r FROM ({SQL_INDEX})) WHERE r = 1
    UNION ALL SELECT page_id, 'p', 'P', '{BASE}' || href, {sql_category("lower('P' || ' ' || href)", CATEGORY_KEYS, fixed.CATEGORY_FALLBACKS)},
        'Go' || (page_id % 7) || ', Java' FROM (SELECT page_id, '/cheatsheets/P' || (page_id % 50) || '.html' AS href FROM pages)
    """,
)
def build_index(spark, sf):
    """Index of every page, its languages included."""
    pages = _with_languages(_pages(spark, sf), "/cheatsheets/P")
    elements = element_table(pages, tags=["a", "img", "article", "main"])
    found = index.build_index(elements, BASE, **INDEX_PATTERNS)
    return found.select("page_id", "id", "title", "url", "category", "languages")


@query(
    "build_index_loose",
    f"""
    SELECT page_id, id, title, url, category FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY n) AS r FROM (
        SELECT page_id, n, coalesce(nullif(lower(regexp_extract(href, '/(th[a-z]+)', 1)), ''), {SQL_SLUG.format("text")}) AS id,
            trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title, '{BASE}' || href AS url,
            {sql_category("lower(trim(text) || ' ' || href)", list(fixed.CATEGORY_ICONS), fixed.CATEGORY_FALLBACKS)} AS category
        FROM ({SQL_ANCHORS}) WHERE contains(lower(href), 'th') OR contains(lower(text), 'th'))) WHERE r = 1
    """,
)
def build_index_loose(spark, sf):
    elements = element_table(_pages(spark, sf), tags=["a"])
    found = index.build_index_loose(elements, BASE, word="th", id_pattern="/(th[a-z]+)")
    return found.select("page_id", "id", "title", "url", "category")


@query(
    "index_summary",
    f"""
    SELECT page_id, count(DISTINCT url) AS total_count, array_to_string(list_sort(list(DISTINCT category)), ', ') AS categories
    FROM ({SQL_INDEX}) GROUP BY 1
    """,
)
def index_summary(spark, sf):
    elements = element_table(_pages(spark, sf), tags=["a"])
    summary = index.index_summary(index.index_entries(elements, BASE, **INDEX_PATTERNS), ["page_id"])
    return summary.withColumn("categories", F.concat_ws(", ", "categories"))


@query(
    "category_index",
    f"""
    SELECT category, count(*) AS links, count(DISTINCT page_id) AS pages FROM
        (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY n) AS r FROM ({SQL_INDEX})) WHERE r = 1 GROUP BY 1
    """,
)
def category_index(spark, sf):
    """Flagship: pages to elements to links to an index, counted per category."""
    elements = element_table(_pages(spark, sf), tags=["a"])
    unique = index.first_per_url(index.index_entries(elements, BASE, **INDEX_PATTERNS))
    return unique.groupBy("category").agg(
        F.count("*").alias("links"), F.countDistinct("page_id").alias("pages")
    )


@query(
    "detail_per_host",
    f"""
    SELECT p.page_id, p.host, r.first_id AS detail_id, d.title FROM
        (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages) p
        JOIN (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, max(page_id) AS first_id FROM pages GROUP BY 1) r USING (host)
        JOIN (SELECT page_id, {SQL_TITLE} AS title FROM pages) d ON d.page_id = r.first_id
    """,
)
def detail_per_host(spark, sf):
    """Pages enriched from one detail page per host: the many side joins a unique side."""
    pages = table(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("host"))
    detail = last_per_key(pages, ["host"], ["page_id"]).withColumnRenamed("page_id", "detail_id")
    # Only the chosen pages are parsed.
    chosen = _pages(spark, sf).join(detail.select(F.col("detail_id").alias("page_id")), "page_id", "left_semi")
    heads = sheets.titles(element_table(chosen, tags=["h1", "title", "html"]))
    named = detail.join(heads.select(F.col("page_id").alias("detail_id"), "title"), "detail_id")
    return pages.join(named, "host").select("page_id", "host", "detail_id", "title")


ROLE_CASE = f"""CASE WHEN {sql_words("lower(text)", fixed.WARNING_MARKS)} THEN 'warning'
    WHEN {sql_words("lower(text)", fixed.TIP_MARKS)} THEN 'tip' ELSE 'content' END"""
SQL_SECTIONS = f"""
    SELECT page_id, coalesce(string_agg(CASE WHEN role = 'content' THEN text END, chr(10) || chr(10) ORDER BY n), '') AS content,
        count(*) FILTER (role = 'warning') AS n_warnings, count(*) FILTER (role = 'tip') AS n_tips
    FROM (SELECT *, {ROLE_CASE} AS role FROM ({SQL_PARAGRAPHS})) GROUP BY 1
"""


def _sectioned(spark, sf):
    """Pages whose h1 is followed by an h2 of the same text, so that each has a section."""
    doubled = F.regexp_replace("html", "<h1>(.*?)</h1>", "<h1>$1</h1><h2>$1</h2>")
    return _pages(spark, sf).withColumn("html", doubled)


@query(
    "page_sections",
    f"""
    SELECT page_id, title, md5(content) AS digest, n_warnings, n_tips FROM ({SQL_SECTIONS}) JOIN (SELECT page_id, {SQL_TITLE} AS title FROM pages) USING (page_id)
    """,
)
def page_sections(spark, sf):
    elements = element_table(_sectioned(spark, sf), cluster=True)
    found = sec.sections(sec.sibling_marks(elements))
    return found.select(
        "page_id", "title", F.md5("content").alias("digest"),
        F.size("warnings").cast("bigint").alias("n_warnings"),
        F.size("tips").cast("bigint").alias("n_tips"),
    )


SQL_TERMS = " + ".join(
    f"cast(contains(lower(title || ' ' || content), '{t}') AS INT)" for t in fixed.SECURITY_TERMS
)


@query(
    "parse_sheets",
    f"""
    SELECT p.page_id, title, {SQL_SLUG.format("title")} AS id, url, left(intro, 500) AS description, intro AS introduction,
        {sql_category("lower(title || ' ' || url)", list(fixed.CATEGORY_ICONS), fixed.CATEGORY_FALLBACKS)} AS category,
        1 AS n_sections, upper(replace(left({SQL_SLUG.format("title")}, 6), 'ß', 'ss')) || '01' AS risk_id,
        CASE WHEN NOT ({sql_words("lower(title || ' ' || content)", fixed.RISK_KEYWORDS)} OR {SQL_TERMS} >= 2) THEN 'Medium'
            {" ".join(f"WHEN {sql_words('lower(content)', w)} THEN '{k.capitalize()}'" for k, w in fixed.SEVERITY_KEYWORDS.items())} ELSE 'Medium' END AS severity,
        CASE WHEN {sql_words("lower(title)", fixed.ATTACK_KEYWORDS)} THEN left(content, 200) ELSE 'Exploit ' || lower(title) || ' vulnerability' END AS goal
    FROM (SELECT page_id, url, {SQL_TITLE} AS title FROM pages) p
    JOIN (SELECT page_id, left(string_agg(text, ' ' ORDER BY n), 1000) AS intro FROM ({SQL_PARAGRAPHS}) WHERE n <= 3 GROUP BY 1) i USING (page_id)
    JOIN ({SQL_SECTIONS}) s USING (page_id)
    """,
)
def parse_sheets(spark, sf):
    pages = _sectioned(spark, sf)
    elements = persist_clustered(element_table(pages, cluster=True))
    parsed = sheets.parse_sheets(elements, pages)
    risk, example = F.get("risks", 0), F.get("attack_examples", 0)
    return parsed.select(
        "page_id", "title", "id", "url", "description", "introduction", "category",
        F.size("sections").alias("n_sections"),
        risk["id"].alias("risk_id"),
        risk["severity"].alias("severity"),
        example["goal"].alias("goal"),
    )


@query(
    "risk_list_entries",
    f"""
    SELECT cast(page_id AS VARCHAR) AS source_id, risk_id, title FROM (SELECT page_id, risk_id, title,
        row_number() OVER (PARTITION BY page_id, risk_id ORDER BY n) AS r FROM
            (SELECT page_id, n, 'A0' || regexp_extract(text, '^.(\\d)(.+)', 1) AS risk_id, trim(regexp_extract(text, '^.(\\d)(.+)', 2)) AS title
             FROM (SELECT page_id, n, length(text) || '0' || (length(text) % 10) || text AS text FROM ({SQL_ANCHORS}))
             WHERE regexp_matches(text, '^.(\\d)(.+)'))) WHERE r = 1
    """,
)
def risk_list_entries(spark, sf):
    """Numbered list entries; the entry's length digit stands in for its number."""
    elements = element_table(_pages(spark, sf), tags=["li"])
    size = F.length("text").cast("string")
    digit = (F.length("text") % 10).cast("string")
    labelled = elements.withColumn("text", F.concat(size, F.lit("0"), digit, F.col("text")))
    found = numbered.risk_list_entries(labelled, r"^.(\d)(.+)")
    return found.select("source_id", "risk_id", "title")
