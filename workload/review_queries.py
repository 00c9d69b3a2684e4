"""Review payloads, rule scans, guardrails, routing and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.keys import report_name
from beaconry.plans import review, rule_index
from beaconry.session import scratch_path
from beaconry.sources import documents
from beaconry.sources.documents import review_state_json
from workload.registry import query, sql_words, table
from workload.text_queries import SQL_FIRST, first_line

SQL_CONTENT = f"""
    SELECT conv_id, CASE WHEN length(c) > 12000 THEN left(c, 12000) || '{fixed.TRUNCATION_NOTICE}' ELSE c END AS content FROM (
        SELECT conv_id, string_agg('=== FILE: ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS c FROM conversations GROUP BY 1)
"""


def _content(spark, sf):
    part = review.file_part(F.col("role"), F.col("text"))
    return review.content_parts(table(spark, sf, "conversations"), "conv_id", "turn", part)


@query("content_parts", f"SELECT conv_id, md5(content) AS digest, length(content) AS n_chars FROM ({SQL_CONTENT})")
def content_parts(spark, sf):
    return _content(spark, sf).select(
        "conv_id", F.md5("content").alias("digest"),
        F.length("content").cast("bigint").alias("n_chars"),
    )


SQL_PAYLOAD = "chr(10) || chr(10)".join(
    [
        f"'{fixed.REVIEW_INSTRUCTION}' || ",
        " || 'Selected guidance: c' || conv_id || ",
        " || 'Guidance details:' || ",
        f" || '{fixed.NO_CONTEXT}' || ",
        " || 'Additional user prompt:' || ",
        f" || '{fixed.NO_PROMPT}' || ",
        " || 'Code/PR content:' || ",
        " || content",
    ]
)


@query("review_payload", f"SELECT conv_id, md5({SQL_PAYLOAD}) AS digest FROM ({SQL_CONTENT})")
def review_payload(spark, sf):
    payload = review.review_payload(
        F.concat(F.lit("c"), "conv_id"), F.lit(""), F.lit(None).cast("string"), F.col("content")
    )
    return _content(spark, sf).select("conv_id", F.md5(payload).alias("digest"))


RULES = [
    review.Rule("mail", "A02", "Mail address in text", r"[a-z0-9_.]+@[a-z0-9.]+", "high", "Remove it"),
    review.Rule("license", "A06", "Licence line", r"(?i)licen[sc]e[^\n]*", "low", "Check terms"),
    review.Rule("digits", "A04", "Long number", r"[0-9]{5,}", "medium", "Mask numbers"),
    review.Rule("token", "A07", "Token or key", r"(?i)(?:token|key|secret)[a-z]*", "medium", "Rotate it"),
]
SQL_FINDINGS = " UNION ALL ".join(
    f"""SELECT doc_id, {n} AS n, '{r.rule_id}' AS rule_id, '{r.risk_level}' AS risk_level,
        regexp_extract(text, '{r.pattern}', 0) AS evidence FROM documents WHERE regexp_matches(text, '{r.pattern}')"""
    for n, r in enumerate(RULES)
)


def _confidence():
    return F.least(F.lit(100), F.floor(F.col("n_chars") / 20))


@query("rule_findings", f"SELECT doc_id, rule_id, risk_level, evidence FROM ({SQL_FINDINGS})")
def rule_findings(spark, sf):
    scanned = review.rule_scan(table(spark, sf, "documents"), "doc_id", "text", RULES)
    return review.finding_rows(scanned, "doc_id").select("doc_id", "rule_id", "risk_level", "evidence")


@query(
    "rule_scan",
    f"""
    SELECT doc_id, CASE WHEN h > 0 THEN 'high' WHEN m > 0 THEN 'medium' WHEN l > 0 THEN 'low' END AS highest_risk, coalesce(h, 0) > 0 AS blocking,
        coalesce(k, 0) AS findings FROM documents LEFT JOIN (SELECT doc_id, count(*) AS k, count(*) FILTER (risk_level = 'high') AS h,
        count(*) FILTER (risk_level = 'medium') AS m, count(*) FILTER (risk_level = 'low') AS l FROM ({SQL_FINDINGS}) GROUP BY 1) USING (doc_id)
    """,
)
def rule_scan(spark, sf):
    scanned = review.rule_scan(table(spark, sf, "documents"), "doc_id", "text", RULES)
    return scanned.select(
        "doc_id", "highest_risk", "blocking", F.size("findings").cast("bigint").alias("findings")
    )


# A rule for each long word of the benchmark texts: the word and the letters after it, in any case.
SQL_WORD_RULES = """
    SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM benchmark)
"""


def _word_rules(spark, sf):
    words = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("w")
    )
    word = F.col("rule_id")
    return words.select(F.lower("w").alias("rule_id")).distinct().select(
        "rule_id", F.lit("A01").alias("category_id"), F.lit("Word of the benchmark").alias("description"),
        F.concat(F.lit("(?i)"), word, F.lit("[a-z]*")).alias("pattern"),
        F.when(word < "m", "high").otherwise("low").alias("risk_level"), F.concat(F.lit("Check "), word).alias("advice"),
    )


@query(
    "rule_table_scan",
    f"""
    SELECT doc_id, w AS rule_id, CASE WHEN w < 'm' THEN 'high' ELSE 'low' END AS risk_level,
        regexp_extract(text, '(?i)' || w || '[a-z]*', 0) AS evidence
    FROM documents JOIN ({SQL_WORD_RULES}) ON contains(lower(text), w)
    """,
)
def rule_table_scan(spark, sf):
    """Findings of a table of rules, one for each long word of the benchmark."""
    scanned = rule_index.rule_table_scan(table(spark, sf, "documents"), "doc_id", "text", _word_rules(spark, sf))
    return review.finding_rows(scanned, "doc_id").select("doc_id", "rule_id", "risk_level", "evidence")


def _reviews(spark, sf):
    """Orders as model outputs: levels from the priority, a stated highest from the status."""
    level = F.lower(F.substring("o_orderpriority", 3, 100))
    vulnerability = F.struct(
        F.col("o_orderstatus").alias("description"), level.alias("risk_level"), F.lit("e").alias("evidence")
    )
    stated = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "O", "low")
    body = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.array(vulnerability)).alias("security_vulnerabilities"),
        stated.alias("highest_risk"),
    )
    return table(spark, sf, "orders").select("o_orderkey", F.to_json(body).alias("raw"))


SQL_LEVEL = "lower(substr(o_orderpriority, 3))"


@query(
    "guardrail_fix",
    f"""
    SELECT o_orderkey, ok, CASE WHEN ok THEN lvl END AS highest_risk, CASE WHEN o_orderstatus = 'P' AND NOT ok THEN 'missing' WHEN NOT ok THEN 'level' END AS failure FROM (
        SELECT *, {SQL_LEVEL} AS lvl, o_orderstatus <> 'P' AND {SQL_LEVEL} IN ('low', 'medium', 'high') AS ok FROM orders)
    """,
)
def guardrail_fix(spark, sf):
    checked = review.guardrail_fix(_reviews(spark, sf), "raw")
    missing = F.col("reason").startswith("missing")
    return checked.select(
        "o_orderkey", "ok", F.lower("fixed.highest_risk").alias("highest_risk"),
        F.when(missing, "missing").when(~F.col("ok"), "level").alias("failure"),
    )


@query(
    "guardrail_strict",
    f"""
    SELECT o_orderkey, o_orderstatus <> 'P' AND {SQL_LEVEL} IN ('low', 'medium', 'high')
        AND {SQL_LEVEL} = CASE o_orderstatus WHEN 'F' THEN 'high' ELSE 'low' END AS ok FROM orders
    """,
)
def guardrail_strict(spark, sf):
    return review.guardrail_strict(_reviews(spark, sf), "raw").select("o_orderkey", "ok")


OWN_DECISIONS = ["approve", "the", "que la"]


@query(
    "decision_check",
    f"SELECT conv_id, turn, {sql_words('lower(text)', OWN_DECISIONS)} AS ok FROM conversations",
)
def decision_check(spark, sf):
    ok = review.decision_ok(F.col("text"), OWN_DECISIONS)
    return table(spark, sf, "conversations").select("conv_id", "turn", ok.alias("ok"))


@query(
    "failed_rules",
    """
    SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT contains(lower(text), 'the') THEN 'names_the' END,
        CASE WHEN NOT length(text) > 200 THEN 'long' END) AS failed FROM conversations
    """,
)
def failed_rules(spark, sf):
    rules = {
        "names_the": F.lower("text").contains("the"),
        "long": F.length("text") > 200,
    }
    failed = F.concat_ws(",", review.failed_rules(rules))
    return table(spark, sf, "conversations").select("conv_id", "turn", failed.alias("failed"))


@query(
    "route_change",
    """
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'ERROR' WHEN length(text) > 300 THEN 'COMPLEX' ELSE 'SIMPLE' END AS route,
        role <> 'system' AND length(text) > 300 AS crew_needed FROM conversations
    """,
)
def route_change(spark, sf):
    """The answer column comes from a size rule; system turns stand for read errors."""
    turns = table(spark, sf, "conversations")
    errors = F.when(F.col("role") == "system", F.array("text"))
    answer = F.when(F.length("text") > 300, "Complex.").otherwise("simple")
    routed = turns.select("conv_id", "turn", review.route_change(errors, answer).alias("route"))
    return routed.withColumn("crew_needed", F.col("route") == "COMPLEX")


@query(
    "decide",
    """
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'escalate' WHEN least(100, n_chars // 20) > 85 THEN 'approve' ELSE 'request changes' END AS decision
    FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
    """,
)
def decide(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    decision = review.decide(_confidence(), F.col("toxic") == 1, F.lit(None).cast("string"))
    return docs.select("doc_id", decision.alias("decision"))


@query(
    "review_fan_in",
    """
    SELECT doc_id, quality, CASE WHEN regexp_matches(text, '[a-z0-9_.]+@[a-z0-9.]+') THEN true ELSE false END AS blocking
    FROM documents JOIN labels USING (doc_id)
    """,
)
def review_fan_in(spark, sf):
    security = review.rule_scan(table(spark, sf, "documents"), "doc_id", "text", RULES)
    joined = review.review_fan_in(table(spark, sf, "labels"), security.select("doc_id", "blocking"), "doc_id")
    return joined.select("doc_id", "quality", "blocking")


def _reports(spark, sf):
    """One rendered report per document; every line longer than 100 becomes a fix."""
    fixes = F.transform(
        F.filter(F.split("text", "\n"), lambda line: F.length(line) > 100),
        lambda line: F.struct(
            F.substring(line, 1, 20).alias("description"), F.lit("s").alias("solutions"),
            F.lit(None).cast("string").alias("explanation"),
        ),
    )
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * interval '1' minute")
    report = review.render_report(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.col("source"), first_line(),
        _confidence(), fixes, F.lit(None).cast("string"),
    )
    return table(spark, sf, "documents").select(
        "doc_id", report_name(at).alias("file_name"), report.alias("content")
    )


SQL_FIXES = "list_filter(string_split(text, chr(10)), lambda l: length(l) > 100)"


@query(
    "render_report",
    f"""
    SELECT doc_id, md5(array_to_string(['# Code Review Report', '', 'Generated: ' || strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S'),
        'Selected guidance: ' || source, '', '## Findings', {SQL_FIRST}, '', '## Confidence', cast(least(100, n_chars // 20) AS VARCHAR), '', '## Fixes']
        || flatten(list_transform({SQL_FIXES}, lambda l: ['- **' || left(l, 20) || '**', '  - Solution: s', '  - Explanation: ']))
        || ['', '## Recommendations', ''], chr(10))) AS digest FROM documents
    """,
)
def render_report(spark, sf):
    return _reports(spark, sf).select("doc_id", F.md5("content").alias("digest"))


@query(
    "parse_reports",
    f"""
    SELECT 'code_review_' || strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y%m%d_%H%M%S') || '.md' AS file_name,
        source AS guidance, least(100, n_chars // 20) AS confidence, length({SQL_FIXES}) AS fix_count FROM documents
    """,
)
def parse_reports(spark, sf):
    parsed = review.parse_reports(_reports(spark, sf))
    return parsed.select(
        "file_name", "guidance", F.col("confidence").cast("bigint").alias("confidence"),
        F.col("fix_count").cast("bigint").alias("fix_count"),
    )


@query(
    "review_trends",
    f"""
    SELECT source AS guidance, count(*) AS reviews, round(avg(least(100, n_chars // 20)), 2) AS avg_confidence, cast(sum(length({SQL_FIXES})) AS BIGINT) AS fixes FROM documents GROUP BY 1
    """,
)
def review_trends(spark, sf):
    trends = review.review_trends(review.parse_reports(_reports(spark, sf)), ["guidance"])
    return trends.withColumn("fixes", F.col("fixes").cast("bigint"))


@query(
    "review_state_json",
    """
    SELECT conv_id, '{"id":"' || conv_id || '","turns":' || count(*) || ',"users":' || count(*) FILTER (role = 'user') || '}' AS state
    FROM conversations GROUP BY 1
    """,
)
def review_states(spark, sf):
    states = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("users")
    )
    return review_state_json(states).select(F.col("id").cast("bigint").alias("conv_id"), "state")


@query(
    "report_table",
    """
    SELECT 'code_review_' || strftime(TIMESTAMP '2026-01-15' + conv_id * INTERVAL 1 SECOND, '%Y%m%d_%H%M%S') || '.md' AS file_name,
        strftime(TIMESTAMP '2026-01-15' + conv_id * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS generated_at,
        md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id
    """,
)
def report_table(spark, sf):
    """Reports written to the report table and read back; every report twice."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text"))).getField("text")
    conversations = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    at = F.expr("timestamp'2026-01-15 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, conv_id)")
    name = F.concat(F.lit("code_review_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".md"))
    reports = conversations.select(name.alias("report_name"), F.array_join("turns", "\n").alias("report"))
    target = scratch_path(spark, "reports")
    for _ in range(2):
        documents.write_reports(reports, target)
    return documents.read_report_table(spark, target).select(
        "file_name", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"), F.md5("content").alias("digest")
    )


@query(
    "json_round_trip",
    "SELECT 'order-' || o_orderkey AS slug, o_orderkey, o_orderstatus FROM orders",
)
def json_round_trip(spark, sf):
    """Records written by slug in two steps, the second replacing a third of the first, and read back."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("Order "), "o_orderkey").alias("title"), "o_orderkey", "o_orderstatus"
    )
    target = scratch_path(spark, "by-slug")
    stale = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.col("o_orderstatus")))
    documents.write_json_by_slug(stale, target, "title", "order", "o_orderkey", 4)
    documents.write_json_by_slug(orders.filter("o_orderkey % 3 = 0"), target, "title", "order", "o_orderkey", 4)
    back = spark.read.schema("slug string, o_orderkey bigint, o_orderstatus string").json(target)
    return back.select("slug", "o_orderkey", "o_orderstatus")
