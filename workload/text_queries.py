"""Scalar rules and predicates over documents, page URLs and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import classify, keys, text, urls
from beaconry.functions import fixed_values as fixed
from beaconry.operators.firsts import first_match
from beaconry.operators.running import ordinal
from beaconry.plans import metrics
from beaconry.plans.sheets import tag_list
from beaconry.sources.pages import read_pages
from workload.registry import query, sql_words, table

SQL_FIRST = "split_part(text, chr(10), 1)"
SQL_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, " \
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
SQL_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


def every_line(spark, sf, *others):
    """``(doc_id, pos, line)`` of every line of the documents, with other columns of theirs."""
    rows = table(spark, sf, "documents").select("doc_id", *others, F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.select("doc_id", *others, F.col("n").cast("bigint").alias("pos"), "line")


def first_line():
    return F.substring_index("text", "\n", 1)


def _doc_lines(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def sql_category(text_sql: str, keys_: list[str], fallbacks=(), default=fixed.DEFAULT_CATEGORY) -> str:
    """CASE expression equal to the category rule for the given dictionary."""
    arms = [f"WHEN contains({text_sql}, '{k}') THEN '{k[0].upper() + k[1:].lower()}'" for k in keys_]
    arms += [f"WHEN {sql_words(text_sql, w)} THEN '{n}'" for n, w in fallbacks]
    return f"CASE {' '.join(arms)} ELSE '{default}' END"


@query(
    "clean_title",
    f"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        {SQL_FIRST} || ' ¶  Cheat  Sheet - Gatehouse notes', '\\s*¶\\s*', ' ', 'g'),
        '(?i)\\s*[-–]\\s*Gatehouse.*$', '', 'g'), '(?i)\\s*Cheat\\s*Sheet\\s*$', '', 'g'),
        '\\s+', ' ', 'g')) AS title
    FROM documents
    """,
)
def clean_title(spark, sf):
    titled = F.concat(first_line(), F.lit(" ¶  Cheat  Sheet - Gatehouse notes"))
    return table(spark, sf, "documents").select("doc_id", text.clean_title(titled, "Gatehouse").alias("title"))


SQL_SLUG = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), "
    "'[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
)


@query(
    "slugify",
    f"""
    SELECT 'part' AS kind, p_partkey AS id, {SQL_SLUG.format("p_name || ' / ' || p_type")} AS slug FROM part
    UNION ALL SELECT 'line ' || pos, doc_id, {SQL_SLUG.format("line")} FROM ({SQL_LINES})
    """,
)
def slugify(spark, sf):
    name = F.concat("p_name", F.lit(" / "), "p_type")
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), text.slugify(name).alias("slug")
    )
    lines = every_line(spark, sf).select(
        F.concat(F.lit("line "), "pos").alias("kind"), F.col("doc_id").alias("id"),
        text.slugify(F.col("line")).alias("slug"),
    )
    return parts.unionByName(lines)


@query(
    "slugify_ascii",
    f"""
    SELECT doc_id, pos, coalesce(nullif(CASE WHEN length(s) > 80 THEN left(s, 71) || '-' || left(md5(s), 8) ELSE s END, ''), 'sheet') AS slug
    FROM (SELECT doc_id, pos, regexp_replace(regexp_replace(lower(trim(line)), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g') AS s FROM ({SQL_LINES}))
    """,
)
def slugify_ascii(spark, sf):
    slug = text.slugify_ascii(F.col("line"), "sheet")
    return every_line(spark, sf).select("doc_id", "pos", slug.alias("slug"))


@query(
    "id_from_url",
    f"""
    SELECT page_id, coalesce(nullif(lower(replace(regexp_extract(url, '/([a-z]+/\\d+)\\.html', 1), '_', '-')), ''),
        {SQL_SLUG.format("regexp_extract(url, '^https?://([^/?#]*)', 1)")}) AS id
    FROM pages
    """,
)
def id_from_url(spark, sf):
    found = urls.id_from_url(F.col("url"), urls.host_of(F.col("url")), r"/([a-z]+/\d+)\.html")
    return table(spark, sf, "pages").select("page_id", found.alias("id"))


@query(
    "title_from_url",
    f"""
    SELECT page_id, regexp_replace(regexp_replace(replace(string_split({SQL_PATH}, '/')[-1], '.html', ''),
        '[_-]', ' ', 'g'), '(?i)\\s+Cheat\\s+Sheet$', '') AS title
    FROM pages
    """,
)
def title_from_url(spark, sf):
    title = urls.title_from_url(F.col("url"))
    return table(spark, sf, "pages").select("page_id", title.alias("title"))


OWN_CATEGORIES = ["thou", "ention", "chung", "ción", "ement"]
OWN_FALLBACKS = [("Grammar", ["ing", "ung"]), ("Prefix", ["re", "be"])]


@query(
    "category_of",
    f"""
    SELECT 'page' AS kind, page_id AS id,
        {sql_category("lower(" + SQL_PATH + " || ' ' || url)", list(fixed.CATEGORY_ICONS), fixed.CATEGORY_FALLBACKS)} AS category
    FROM pages
    UNION ALL SELECT 'document', doc_id,
        {sql_category("lower(text || ' ' || source)", OWN_CATEGORIES, OWN_FALLBACKS, "Other")} FROM documents
    """,
)
def category_of(spark, sf):
    url = F.col("url")
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        classify.category_of(urls.path_of(url), url).alias("category"),
    )
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        classify.category_of(
            F.col("text"), F.col("source"), OWN_CATEGORIES, OWN_FALLBACKS, "Other"
        ).alias("category"),
    )
    return pages.unionByName(docs)


SEVERITY_CASE = "CASE " + " ".join(
    f"WHEN {sql_words('lower(text)', words)} THEN '{level.capitalize()}'"
    for level, words in fixed.SEVERITY_KEYWORDS.items()
) + f" ELSE '{fixed.DEFAULT_SEVERITY}' END"


@query("assess_severity", f"SELECT doc_id, {SEVERITY_CASE} AS severity FROM documents")
def assess_severity(spark, sf):
    level = classify.assess_severity(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", level.alias("severity"))


OWN_SEVERITY = {"critical": ["worthless", "über"], "high": ["the", "und"], "low": ["que", "ción"]}


@query(
    "assess_severity_words",
    "SELECT doc_id, CASE "
    + " ".join(
        "WHEN " + " OR ".join(
            f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')" for w in words
        ) + f" THEN '{level.capitalize()}'"
        for level, words in OWN_SEVERITY.items()
    )
    + " ELSE 'Medium' END AS severity FROM documents",
)
def assess_severity_words(spark, sf):
    level = classify.assess_severity(F.col("text"), OWN_SEVERITY, word_boundary=True)
    return table(spark, sf, "documents").select("doc_id", level.alias("severity"))


@query(
    "severity_distribution",
    f"SELECT severity, count(*) AS n FROM (SELECT {SEVERITY_CASE} AS severity FROM documents) GROUP BY 1",
)
def severity_distribution(spark, sf):
    level = classify.assess_severity(F.col("text")).alias("severity")
    return metrics.distribution(table(spark, sf, "documents").select(level), "severity")


ICON_CODES = {"click": "C", "view": "V", "purchase": "P"}


@query(
    "icon_lookup",
    """
    SELECT event_type, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V'
        WHEN 'purchase' THEN 'P' ELSE '?' END AS code, count(*) AS n
    FROM events GROUP BY 1, 2
    """,
)
def icon_lookup(spark, sf):
    code = classify.lookup(F.col("event_type"), ICON_CODES, "?").alias("code")
    return table(spark, sf, "events").groupBy("event_type", code).agg(F.count("*").alias("n"))


@query(
    "severity_icons",
    """
    SELECT o_orderkey, CASE s WHEN 'High' THEN '🟠' WHEN 'Medium' THEN '🟡' WHEN 'Low' THEN '🟢' ELSE '⚪' END AS icon,
        CASE s WHEN 'High' THEN '#ff8c00' WHEN 'Medium' THEN '#ffd700' WHEN 'Low' THEN '#32cd32' ELSE '#888' END AS color
    FROM (SELECT o_orderkey, upper(substr(o_orderpriority, 3, 1)) || lower(substr(o_orderpriority, 4)) AS s FROM orders)
    """,
)
def severity_icons(spark, sf):
    name = text.capitalize(F.substring("o_orderpriority", 3, 100))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        classify.severity_icon(name).alias("icon"),
        classify.severity_color(name).alias("color"),
    )


@query(
    "category_icons",
    "SELECT page_id, CASE "
    + " ".join(
        f"WHEN lower({sql_category('lower(url)', list(fixed.CATEGORY_ICONS))}) = '{k}' THEN '{v}'"
        for k, v in fixed.CATEGORY_ICONS.items()
    )
    + f" ELSE '{fixed.DEFAULT_CATEGORY_ICON}' END AS icon FROM pages",
)
def category_icons(spark, sf):
    category = classify.category_of(F.lit(""), F.col("url"), fallbacks=())
    return table(spark, sf, "pages").select("page_id", classify.category_icon(category).alias("icon"))


@query(
    "normalize_severity",
    """
    SELECT o_orderkey, CASE lower(trim(substr(o_orderpriority, 3))) WHEN 'critical' THEN 'Critical'
        WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS severity
    FROM orders
    """,
)
def normalize_severity(spark, sf):
    level = classify.normalize_severity(F.substring("o_orderpriority", 3, 100))
    return table(spark, sf, "orders").select("o_orderkey", level.alias("severity"))


@query(
    "risk_ids",
    """
    SELECT doc_id, n AS section_no, upper(left(source, 6)) || CASE WHEN n < 10 THEN '0' ELSE '' END || cast(n AS VARCHAR) AS risk_id
    FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    """,
)
def risk_ids(spark, sf):
    """Ordinals per source; the chunked count keeps a dominant source distributed."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    chunk = F.floor(F.col("doc_id") / 100_000)
    numbered = ordinal(docs, ["source"], ["doc_id"], chunk, "section_no")
    made = keys.risk_id(text.slugify(F.col("source")), F.col("section_no"))
    return numbered.select("doc_id", "section_no", made.alias("risk_id"))


CODE_CONDITION = (
    "(" + " OR ".join(f"starts_with(b, '{p}')" for p in fixed.CODE_LINE_PREFIXES)
    + " OR " + " OR ".join(f"ends_with(b, '{s}')" for s in fixed.CODE_LINE_SUFFIXES)
    + " OR (contains(b, '=') AND contains(b, '\"') AND contains(b, ':'))"
    + " OR regexp_matches(b, '^[\\p{L}\\p{N}_]+\\s*[=:]\\s*[\\[\\{\"'']'))"
)


def sql_prose(text_sql: str) -> str:
    """Text without code-like lines, as a DuckDB list expression."""
    condition = CODE_CONDITION.replace("(b,", "(trim(l),")
    return (
        f"array_to_string(list_filter(string_split({text_sql}, chr(10)), "
        f"lambda l: NOT {condition}), chr(10))"
    )


@query(
    "drop_code_lines",
    f"SELECT doc_id, md5(p) AS digest, length(p) AS n_chars FROM (SELECT doc_id, {sql_prose('text')} AS p FROM documents)",
)
def drop_code_lines(spark, sf):
    prose = table(spark, sf, "documents").select("doc_id", text.drop_code_lines(F.col("text")).alias("p"))
    return prose.select("doc_id", F.md5("p").alias("digest"), F.length("p").cast("bigint").alias("n_chars"))


_STRIPPED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), "
    "'`[^`]+`', '', 'g'), '\\{[^}]*\\}', '', 'g'), '\\[[^\\]]*\\]', '', 'g')"
)


@query(
    "clean_description",
    f"""
    SELECT doc_id, CASE WHEN text = '' THEN '' WHEN length(d) < 20 THEN '{fixed.EMPTY_DESCRIPTION}' ELSE d END AS description
    FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace({sql_prose(_STRIPPED)},
        '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS d FROM documents)
    """,
)
def clean_description(spark, sf):
    cleaned = text.clean_description(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", cleaned.alias("description"))


def _sql_all(pattern: str) -> str:
    return "regexp_extract_all(text, '(?i)" + pattern.replace("'", "''") + "', 1)"


@query(
    "recommendations",
    f"""
    WITH found AS (SELECT doc_id, list_concat({", ".join(_sql_all(p) for p in fixed.RECOMMENDATION_PATTERNS)}) AS l FROM documents),
    each AS (SELECT doc_id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM found),
    kept AS (SELECT doc_id, regexp_replace(r, '^\\s+|\\s+$', '', 'g') AS recommendation, min(i) AS i FROM each WHERE length(r) > 20 GROUP BY 1, 2)
    SELECT doc_id, recommendation, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM kept) WHERE rank <= 10
    """,
)
def recommendations(spark, sf):
    found = text.recommendations(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("n", "recommendation"))
    return rows.select("doc_id", "recommendation", (F.col("n") + 1).cast("bigint").alias("rank"))


@query(
    "title_tags",
    f"""
    WITH words AS (SELECT doc_id, pos, [lang] || list_transform(list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'),
        lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND length(w) > 3), lambda w: lower(w)) AS l
        FROM ({SQL_LINES}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)),
    each AS (SELECT doc_id, pos, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM words),
    firsts AS (SELECT doc_id, pos, tag, min(i) AS i FROM each GROUP BY 1, 2, 3)
    SELECT doc_id, pos, tag, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY i) AS rank FROM firsts) WHERE rank <= 10
    """,
)
def title_tags(spark, sf):
    tags = tag_list(F.col("lang"), F.lit(None), F.col("line"))
    rows = every_line(spark, sf, "lang").select("doc_id", "pos", F.posexplode(tags).alias("n", "tag"))
    return rows.select("doc_id", "pos", "tag", (F.col("n") + 1).cast("bigint").alias("rank"))


@query(
    "content_keys",
    """
    SELECT page_id, left(sha256(url), 32) AS cache_key, left(sha256(html), 16) AS content_hash FROM pages
    """,
)
def content_keys(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        keys.cache_key(F.col("url")).alias("cache_key"),
        keys.text_hash(F.col("html")).alias("content_hash"),
    )


@query(
    "expiry_dates",
    """
    SELECT o_orderkey, strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS page_expiry,
        strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS index_expiry FROM orders
    """,
)
def expiry_dates(spark, sf):
    created = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(keys.expires_at(created), "yyyy-MM-dd").alias("page_expiry"),
        F.date_format(keys.expires_at(created, is_index=True), "yyyy-MM-dd").alias("index_expiry"),
    )


@query(
    "strip_bullets",
    f"""
    SELECT doc_id, pos, regexp_replace(line, '^[\\-*\\d\\.]+\\s+', '') AS plain,
        regexp_replace(line, '^[\\-\\*•\\d\\.\\)]+\\s*', '') AS item
    FROM ({SQL_LINES})
    """,
)
def strip_bullets(spark, sf):
    line = F.col("line")
    return _doc_lines(spark, sf).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        text.strip_bullet(line).alias("plain"), text.strip_list_marker(line).alias("item"),
    )


@query(
    "risk_numbers",
    f"""
    SELECT page_id, 'A' || lpad(regexp_extract(url, '/(\\d{{1,2}})\\d*(.*)', 1), 2, '0') AS risk_id,
        trim(regexp_extract(url, '/(\\d{{1,2}})\\d*(.*)', 2)) AS title
    FROM pages WHERE regexp_matches(url, '/(\\d{{1,2}})\\d*(.*)')
    """,
)
def risk_numbers(spark, sf):
    pattern = r"/(\d{1,2})\d*(.*)"
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.risk_number(url, pattern).alias("risk_id"),
        urls.risk_label_title(url, pattern).alias("title"),
    ).filter("risk_id is not null")


@query(
    "display_titles",
    f"""
    SELECT p_partkey, array_to_string(list_transform(string_split(s, '-'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title
    FROM (SELECT p_partkey, {SQL_SLUG.format("p_name")} AS s FROM part)
    """,
)
def display_titles(spark, sf):
    title = text.display_title(text.slugify(F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", title.alias("title"))


@query(
    "report_names",
    """
    SELECT o_orderkey, 'code_review_' || strftime(o_orderdate + to_seconds(o_orderkey), '%Y%m%d_%H%M%S') || '.md' AS report_name,
        strftime(o_orderdate + to_seconds(o_orderkey), '%Y-%m-%dT%H:%M:%S') AS generated
    FROM orders
    """,
)
def report_names(spark, sf):
    at = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)"))
    named = table(spark, sf, "orders").select("o_orderkey", keys.report_name(at).alias("report_name"))
    back = keys.report_timestamp(F.col("report_name"))
    return named.withColumn("generated", F.date_format(back, "yyyy-MM-dd'T'HH:mm:ss"))


@query(
    "capitalize",
    "SELECT n_nationkey, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS name FROM nation",
)
def capitalize(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.capitalize(F.col("n_name")).alias("name"))


@query(
    "join_list",
    f"SELECT doc_id, pos, array_to_string(string_split(line, ' '), ', ') AS words FROM ({SQL_LINES})",
)
def join_list(spark, sf):
    words = F.concat_ws(", ", F.split("line", " "))
    return every_line(spark, sf).select("doc_id", "pos", words.alias("words"))


@query(
    "truncate_text",
    """
    SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS card,
        left(text, 200) AS snippet, left(text, 150) || '...' AS always FROM documents
    """,
)
def truncate_text(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.truncate(body, fixed.CARD_CHARS).alias("card"),
        F.substring(body, 1, fixed.SNIPPET_CHARS).alias("snippet"),
        text.truncate(body, fixed.CARD_CHARS, always=True).alias("always"),
    )


@query(
    "context_cap",
    """
    SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id,
        CASE WHEN length(text) > 12000 THEN left(text, 12000) || ' [cut]' ELSE text END AS c FROM documents)
    """,
)
def context_cap(spark, sf):
    capped = table(spark, sf, "documents").select(
        "doc_id", text.cap_context(F.col("text"), notice=" [cut]").alias("c")
    )
    return capped.select("doc_id", F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("digest"))


OWN_WARNINGS, OWN_TIPS = ["thou", "über", "nicht"], ["que", "ción", "ing"]


@query(
    "paragraph_role",
    f"""
    SELECT doc_id, pos, CASE WHEN {sql_words("lower(line)", OWN_WARNINGS)} THEN 'warning'
        WHEN {sql_words("lower(line)", OWN_TIPS)} THEN 'tip' ELSE 'content' END AS role
    FROM ({SQL_LINES})
    """,
)
def paragraph_role(spark, sf):
    role = text.paragraph_role(F.col("line"), OWN_WARNINGS, OWN_TIPS)
    return _doc_lines(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), role.alias("role"))


@query(
    "risk_texts",
    f"SELECT doc_id FROM documents WHERE {sql_words('lower(text)', fixed.RISK_KEYWORDS)} "
    f"OR {sql_words('lower(source)', fixed.RISK_KEYWORDS)}",
)
def risk_texts(spark, sf):
    found = classify.is_risk_text(F.col("source"), F.col("text"))
    return table(spark, sf, "documents").filter(found).select("doc_id")


OWN_TERMS = ["the", "of", "que", "der", "und", "la", "in", "ention", "thou"]


@query(
    "term_counts",
    "SELECT doc_id, terms FROM (SELECT doc_id, "
    + " + ".join(f"cast(contains(lower(text), '{t}') AS INT)" for t in OWN_TERMS)
    + " AS terms FROM documents) WHERE terms >= 2",
)
def term_counts(spark, sf):
    count = classify.term_count(F.col("text"), OWN_TERMS)
    return table(spark, sf, "documents").select("doc_id", count.alias("terms")).filter("terms >= 2")


OWN_ATTACK = ["ation", "ment", "ung"]


@query(
    "attack_titles",
    f"SELECT doc_id, {SQL_FIRST} AS title FROM documents WHERE {sql_words(f'lower({SQL_FIRST})', OWN_ATTACK)}",
)
def attack_titles(spark, sf):
    titled = table(spark, sf, "documents").select("doc_id", first_line().alias("title"))
    return titled.filter(classify.is_attack_title(F.col("title"), OWN_ATTACK))


@query(
    "drop_boilerplate",
    f"SELECT doc_id FROM documents WHERE NOT {sql_words(f'lower({SQL_FIRST})', ['the', 'der', 'la'])}",
)
def drop_boilerplate(spark, sf):
    skip = classify.is_boilerplate_title(first_line(), ["the", "der", "la"])
    return table(spark, sf, "documents").filter(~skip).select("doc_id")


@query("by_category", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def by_category(spark, sf):
    return metrics.by_category(table(spark, sf, "documents"), "lang", "en").select("doc_id", "lang")


@query("category_set", "SELECT DISTINCT lang FROM documents")
def category_set(spark, sf):
    return metrics.categories(table(spark, sf, "documents"), "lang")


@query(
    "first_match",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 1",
)
def first_match_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return first_match(orders, F.col("o_orderpriority") == "2-HIGH", ["o_orderkey"])


@query(
    "first_match_default",
    "SELECT min(o_orderkey) AS o_orderkey FROM orders",
)
def first_match_default(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    missing = F.col("o_orderpriority") == "no such priority"
    return first_match(orders, missing, ["o_orderkey"]).select("o_orderkey")


@query(
    "with_defaults",
    """
    SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def with_defaults(spark, sf):
    labels = table(spark, sf, "labels")
    joined = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")]
    )


@query("read_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages WHERE length(html) > 0")
def read_all_pages(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet", successful_only=True)
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("index_order", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey")
def index_order(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return parts.orderBy(F.lower("p_name"), "p_partkey")


SQL_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


@query(
    "meta_keywords",
    f"""
    SELECT doc_id, keyword, count(*) AS n FROM (SELECT doc_id, lower({SQL_TRIM.format("k")}) AS keyword
        FROM (SELECT doc_id, unnest(string_split(text, ',')) AS k FROM documents)) WHERE keyword <> '' GROUP BY 1, 2
    """,
)
def meta_keywords(spark, sf):
    """Every text as the content of a keywords element."""
    found = table(spark, sf, "documents").select(
        "doc_id", F.explode(text.meta_keywords(F.col("text"))).alias("keyword")
    )
    return found.groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))


@query("decode_lossy", "SELECT doc_id, md5(text) AS digest, length(text) AS n_chars FROM documents")
def decode_lossy(spark, sf):
    """Texts from bytes with a byte in front that is no UTF-8."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))
    decoded = table(spark, sf, "documents").select("doc_id", text.decode_lossy(raw).alias("t"))
    return decoded.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))
