"""Line-state rules over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import text
from beaconry.functions import fixed_values as fixed
from beaconry.operators import lines as ln
from beaconry.plans import numbered, sheets
from workload.registry import query, sql_words, table
from workload.text_queries import (
    SQL_LINES, _STRIPPED, _sql_all, sql_prose,
)

# Documents have no bullets, so lines starting with a word of two or three letters get one.
SQL_BULLETED = f"""
    SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^[A-Z][a-z]{{1,2}} ') THEN '- ' || line
        WHEN length(line) < 25 THEN '# ' || line ELSE line END AS line FROM ({SQL_LINES})
"""
TRIGGERS = ["worthless", "übe", "ention", "ation", "ción"]


def _bulleted(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = F.transform(
        F.split("text", "\n"),
        lambda line: F.when(line.rlike("^[A-Z][a-z]{1,2} "), F.concat(F.lit("- "), line))
        .when(F.length(line) < 25, F.concat(F.lit("# "), line))
        .otherwise(line),
    )
    return docs.select("doc_id", F.array_join(marked, "\n").alias("text"))


SQL_ITEMS = f"""
    SELECT doc_id, pos, regexp_replace(bare, '^[\\-\\*•\\d\\.\\)]+\\s*', '') AS item FROM (
        SELECT doc_id, pos, bare, trig, listed, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM (
            SELECT doc_id, pos, bare, trig, listed, CASE WHEN trig THEN 1 WHEN NOT listed AND (bare = '' OR starts_with(bare, '#')) THEN 0 END AS ev FROM (
                SELECT doc_id, pos, trim(line) AS bare, {sql_words("lower(line)", TRIGGERS)} AS trig,
                    regexp_matches(trim(line), '^([\\-\\*•]|\\d+[\\.\\)])\\s+') AS listed FROM ({SQL_BULLETED}))))
    WHERE st = 1 AND NOT trig AND listed AND length(regexp_replace(bare, '^[\\-\\*•\\d\\.\\)]+\\s*', '')) > 10
"""


@query("list_items", SQL_ITEMS)
def list_items(spark, sf):
    lines = ln.line_table(_bulleted(spark, sf), ["doc_id"], "text")
    found = ln.list_item_rows(lines, ["doc_id"], TRIGGERS)
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "first_list_items",
    f"SELECT doc_id, rank, item FROM (SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM ({SQL_ITEMS})) WHERE rank <= 5",
)
def first_list_items(spark, sf):
    """The capped form, folded inside each row without a shuffle."""
    found = text.list_items(F.col("text"), TRIGGERS, 5)
    rows = _bulleted(spark, sf).select("doc_id", F.posexplode(found).alias("n", "item"))
    return rows.select("doc_id", (F.col("n") + 1).cast("bigint").alias("rank"), "item")


BUCKETS = [("the", "impacts"), ("of", "mitigations"), ("la", "mitigations"), ("d", "examples")]
SQL_BUCKET = "CASE " + " ".join(
    f"WHEN starts_with(lower(line), '{p}') THEN '{b}'" for p, b in BUCKETS
) + " END"


@query(
    "bucket_lines",
    f"""
    SELECT doc_id, pos, bucket, regexp_replace(line, '^[\\-*\\d\\.]+\\s+', '') AS line FROM (
        SELECT doc_id, pos, line, opened, last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS bucket
        FROM (SELECT doc_id, pos, line, {SQL_BUCKET} AS opened FROM ({SQL_LINES})))
    WHERE opened IS NULL AND bucket IS NOT NULL
    """,
)
def bucket_lines(spark, sf):
    lines = ln.line_table(table(spark, sf, "documents"), ["doc_id"], "text")
    found = ln.bucket_rows(lines, ["doc_id"], BUCKETS)
    return found.withColumn("pos", F.col("pos").cast("bigint"))


HEADING = r"^[A-Z]\S{0,2}\s+(.{1,60})$"
SQL_FILLED = f"""
    SELECT doc_id, pos, bare, head, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'body') AS header FROM (
        SELECT doc_id, pos, trim(line) AS bare, CASE WHEN regexp_matches(line, '{HEADING}') THEN lower(trim(regexp_extract(line, '{HEADING}', 1))) END AS head
        FROM ({SQL_LINES}))
"""


def _filled(spark, sf):
    lines = ln.line_table(table(spark, sf, "documents"), ["doc_id"], "text")
    return ln.heading_fill(lines, ["doc_id"], HEADING)


@query(
    "heading_fill",
    f"SELECT doc_id, pos, header, head IS NOT NULL AS is_heading FROM ({SQL_FILLED})",
)
def heading_fill(spark, sf):
    found = _filled(spark, sf)
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "header", "is_heading")


@query(
    "header_buckets",
    f"""
    SELECT doc_id, header, min(pos) AS first_pos, count(CASE WHEN head IS NULL THEN 1 END) AS n_lines,
        md5(coalesce(string_agg(CASE WHEN head IS NULL THEN bare END, chr(10) ORDER BY pos), '')) AS digest
    FROM ({SQL_FILLED}) WHERE head IS NOT NULL OR bare <> '' GROUP BY 1, 2
    """,
)
def header_buckets(spark, sf):
    found = ln.header_buckets(_filled(spark, sf), ["doc_id"])
    return found.select(
        "doc_id", "header", F.col("first_pos").cast("bigint").alias("first_pos"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.md5(F.array_join("lines", "\n")).alias("digest"),
    )


KEY_WORDS = ["re", "th", "de"]


@query(
    "collect_by_keys",
    f"""
    WITH l AS (SELECT f.doc_id, f.pos, f.header, h.first_pos, regexp_replace(bare, '^[\\-*\\d\\.]+\\s+', '') AS item FROM ({SQL_FILLED}) f
        JOIN (SELECT doc_id, header, min(pos) AS first_pos FROM ({SQL_FILLED}) WHERE head IS NOT NULL OR bare <> '' GROUP BY 1, 2) h
        USING (doc_id, header) WHERE f.head IS NULL AND bare <> ''),
    k AS (SELECT unnest({KEY_WORDS!r}) AS word, generate_subscripts({KEY_WORDS!r}, 1) AS k),
    m AS (SELECT doc_id, item, min((k, first_pos, pos)) AS o FROM l JOIN k ON contains(header, word) WHERE item <> '' GROUP BY 1, 2)
    SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rank FROM m
    """,
)
def collect_by_keys(spark, sf):
    headers = ln.headers_per_key(ln.header_buckets(_filled(spark, sf), ["doc_id"]), ["doc_id"])
    items = ln.collect_by_keys(F.col("headers"), KEY_WORDS)
    rows = headers.select("doc_id", F.posexplode(items).alias("n", "item"))
    return rows.select("doc_id", "item", (F.col("n") + 1).cast("bigint").alias("rank"))


LIST_WORDS = {"impacts": ["re", "th"], "mitigations": ["de"], "examples": ["zz", "ou"], "types": ["in"]}


def _sql_list(words):
    return f"""
    SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rank FROM (
        SELECT doc_id, item, min((k, first_pos, pos)) AS o FROM (
            SELECT f.doc_id, f.pos, f.header, h.first_pos, regexp_replace(bare, '^[\\-*\\d\\.]+\\s+', '') AS item FROM ({SQL_FILLED}) f
            JOIN (SELECT doc_id, header, min(pos) AS first_pos FROM ({SQL_FILLED}) WHERE head IS NOT NULL OR bare <> '' GROUP BY 1, 2) h
            USING (doc_id, header) WHERE f.head IS NULL AND bare <> '') l
        JOIN (SELECT unnest({words!r}) AS word, generate_subscripts({words!r}, 1) AS k) ON contains(header, word) WHERE item <> '' GROUP BY 1, 2)
    """


@query(
    "risk_page_markdown",
    f"""
    SELECT d.doc_id, coalesce(b.bare, '') AS description, coalesce(i.n, 0) AS n_impacts, coalesce(i.digest, md5('')) AS impacts,
        coalesce(m.n, 0) AS n_mitigations, coalesce(e.n, 0) AS n_examples, coalesce(t.n, 0) AS n_types
    FROM documents d
    LEFT JOIN (SELECT doc_id, min_by(bare, pos) AS bare FROM ({SQL_FILLED}) WHERE header = 'body' AND head IS NULL AND bare <> '' GROUP BY 1) b USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n, md5(string_agg(item, '|' ORDER BY rank)) AS digest FROM ({_sql_list(LIST_WORDS["impacts"])}) GROUP BY 1) i USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_sql_list(LIST_WORDS["mitigations"])}) GROUP BY 1) m USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_sql_list(LIST_WORDS["examples"])}) GROUP BY 1) e USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_sql_list(LIST_WORDS["types"])}) WHERE rank <= 5 GROUP BY 1) t USING (doc_id)
    """,
)
def risk_page_markdown(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.col("text").alias("markdown"))
    found = numbered.risk_page_markdown(pages, ["doc_id"], HEADING, LIST_WORDS)
    return found.select(
        "doc_id",
        "description",
        F.size("impacts").cast("bigint").alias("n_impacts"),
        F.md5(F.array_join("impacts", "|")).alias("impacts"),
        F.size("mitigations").cast("bigint").alias("n_mitigations"),
        F.size("examples").cast("bigint").alias("n_examples"),
        F.size("types").cast("bigint").alias("n_types"),
    )


@query(
    "number_items",
    """
    SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
        'Example ' || generate_subscripts(string_split(text, chr(10)), 1) AS label FROM conversations
    """,
)
def number_items(spark, sf):
    turns = table(spark, sf, "conversations")
    rows = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.select(
        "conv_id", "turn", "line", F.concat(F.lit("Example "), (F.col("n") + 1)).alias("label")
    )


# Documents have no numbered headings: a short line becomes "# A<n>: line", its n being its length.
SQL_MARKED = f"""
    SELECT doc_id, pos, line, length(line) % 12 AS d, length(line) < 40 AND length(trim(line)) > 0 AS is_head FROM ({SQL_LINES})
"""


def _numbered_markdown(spark, sf):
    docs = table(spark, sf, "documents")
    marked = F.transform(
        F.split("text", "\n"),
        lambda line: F.when(
            (F.length(line) < 40) & (F.length(F.trim(line)) > 0),
            F.concat(F.lit("# A"), (F.length(line) % 12).cast("string"), F.lit(": "), line),
        ).otherwise(line),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("source_id"), F.array_join(marked, "\n").alias("markdown")
    )


@query(
    "risks_from_markdown",
    f"""
    WITH l AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS hid FROM ({SQL_MARKED})),
    heads AS (SELECT doc_id, hid, 'A' || d AS risk_id, trim(line) AS title FROM l WHERE is_head),
    body AS (SELECT doc_id, hid, trim(line) AS line, row_number() OVER (PARTITION BY doc_id, hid ORDER BY pos) AS n
             FROM l WHERE NOT is_head AND hid > 0 AND trim(line) <> ''),
    h AS (SELECT heads.*, coalesce(b.line, '') AS description,
            row_number() OVER (PARTITION BY heads.doc_id, risk_id ORDER BY heads.hid DESC) AS r,
            cast(min(heads.hid) OVER (PARTITION BY heads.doc_id, risk_id) - 1 AS BIGINT) AS risk_no
          FROM heads LEFT JOIN body b ON b.doc_id = heads.doc_id AND b.hid = heads.hid AND b.n = 1)
    SELECT cast(doc_id AS VARCHAR) AS source_id, risk_id, risk_no, title, description FROM h WHERE r = 1
    """,
)
def risks_from_markdown(spark, sf):
    found = numbered.risks_from_markdown(_numbered_markdown(spark, sf))
    return found.select(
        "source_id", "risk_id", F.col("risk_no").cast("bigint").alias("risk_no"), "title", "description"
    )


SQL_SECTIONS = f"""
    SELECT doc_id AS page_id, source AS sheet_title, pos + 1 AS section_no,
        array_to_string(string_split(line, ' ')[1:4], ' ') AS title, line AS text
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
"""
SQL_SECURITY_TERMS = " + ".join(
    f"cast(contains(lower(title || ' ' || text), '{t}') AS INT)" for t in fixed.SECURITY_TERMS
)


def _sections(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text").repartition("doc_id")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("sheet_title"),
        (F.col("n") + 1).alias("section_no"),
        F.substring_index("line", " ", 4).alias("title"),
        F.col("line").alias("content"),
        F.array().cast("array<string>").alias("code_examples"),
    )


SQL_RISKS = f"""
    SELECT page_id, CASE WHEN risky THEN section_no ELSE 1 END AS risk_no,
        CASE WHEN risky THEN title ELSE sheet_title END AS title, risky, text, sheet_title FROM (
        SELECT *, max(risky) OVER (PARTITION BY page_id) AS any_risk FROM (
            SELECT *, {sql_words("lower(text)", fixed.RISK_KEYWORDS)} OR {sql_words("lower(title)", fixed.RISK_KEYWORDS)}
                OR {SQL_SECURITY_TERMS} >= 2 AS risky FROM ({SQL_SECTIONS})))
    WHERE risky OR (NOT any_risk AND section_no = 1)
"""


#: Recommendations of a risk: distinct ones by pattern, then place; seven of a risky section, five of a stand-in.
SQL_ADVICE = f"""
    SELECT page_id, risk_no, line, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, risk_no ORDER BY i) AS n FROM (
        SELECT page_id, risk_no, risky, trim(r) AS line, min(i) AS i FROM (
            SELECT page_id, risk_no, risky, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (
                SELECT page_id, risk_no, risky, list_concat({", ".join(_sql_all(p) for p in fixed.RECOMMENDATION_PATTERNS)}) AS l FROM ({SQL_RISKS})))
        WHERE length(r) > 20 GROUP BY 1, 2, 3, 4)) WHERE n <= CASE WHEN risky THEN 7 ELSE 5 END
"""


@query(
    "section_risks",
    f"""
    SELECT page_id, risk_no, upper(left(sheet_title, 6)) || CASE WHEN risk_no < 10 THEN '0' ELSE '' END || risk_no AS risk_id, title,
        CASE WHEN NOT risky THEN 'Medium' {" ".join(f"WHEN {sql_words('lower(text)', w)} THEN '{k.capitalize()}'" for k, w in fixed.SEVERITY_KEYWORDS.items())} ELSE 'Medium' END AS severity,
        left(CASE WHEN text = '' THEN '' WHEN length(d) < 20 THEN '{fixed.EMPTY_DESCRIPTION}' ELSE d END, 500) AS description,
        part, n, line
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace({sql_prose(_STRIPPED)},
        '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS d FROM ({SQL_RISKS}))
    LEFT JOIN (SELECT page_id, risk_no, 'mitigations' AS part, n, line FROM ({SQL_ADVICE})) USING (page_id, risk_no)
    """,
)
def section_risks(spark, sf):
    """Risks of every section with each line of their lists as a row."""
    found = numbered.list_rows(
        sheets.risks(_sections(spark, sf)), ["page_id", "risk_no", "risk_id", "title", "severity", "description"]
    )
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("risk_no", "n")})


@query(
    "section_attacks",
    f"""
    WITH risks AS (SELECT r.page_id, r.risk_no, r.title AS risk_title,
            upper(left(sheet_title, 6)) || CASE WHEN r.risk_no < 10 THEN '0' ELSE '' END || r.risk_no AS risk_id, a.line AS advice
        FROM ({SQL_RISKS}) r LEFT JOIN ({SQL_ADVICE}) a ON a.page_id = r.page_id AND a.risk_no = r.risk_no AND a.n = 1),
    attacks AS (SELECT page_id, section_no, title, text FROM ({SQL_SECTIONS}) WHERE {sql_words("lower(title)", fixed.ATTACK_KEYWORDS)}),
    matched AS (SELECT a.page_id, a.section_no, a.title, a.text, r.risk_no, r.risk_id, r.advice,
            row_number() OVER (PARTITION BY a.page_id, a.section_no ORDER BY NOT contains(lower(a.title), lower(r.risk_title)), r.risk_no) AS k
        FROM attacks a JOIN risks r USING (page_id)),
    scenarios AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY risk_no) AS k FROM risks
        WHERE page_id NOT IN (SELECT page_id FROM attacks))
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY section_no) AS example_no, title, left(text, 200) AS goal,
        risk_id, '' AS attack_prompt, '' AS impact, coalesce(advice, '') AS mitigation FROM matched WHERE k = 1
    UNION ALL SELECT page_id, k, risk_title || ' Attack Scenario', 'Exploit ' || lower(risk_title) || ' vulnerability', risk_id,
        '{fixed.SCENARIO_PROMPT.replace("'", "''")}', '{fixed.SCENARIO_IMPACT.replace("'", "''")}', coalesce(advice, '{fixed.SCENARIO_MITIGATION.replace("'", "''")}')
        FROM scenarios WHERE k <= 3
    """,
)
def section_attacks(spark, sf):
    sections = _sections(spark, sf)
    found = sheets.attack_examples(sections)
    return found.withColumn("example_no", F.col("example_no").cast("bigint"))
