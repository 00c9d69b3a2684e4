"""Review work as batch jobs: payloads, rule scans, guardrails, routing, reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.keys import report_timestamp
from beaconry.functions.text import cap_context, contains_any
from beaconry.operators.running import running_before
from beaconry.plans.metrics import highest_level
from beaconry.sources import schemas

SEPARATOR = "\n\n"


def content_parts(
    parts: DataFrame,
    key: str,
    order: str,
    text: Column,
    limit: int = fixed.REVIEW_CHAR_LIMIT,
    chunk: int = 1_000,
) -> DataFrame:
    """All parts of a key joined by blank lines and cut at ``limit`` with a notice.

    The start of every part is a chunked running length over the numeric ``order``;
    parts starting behind the limit cannot show and are not gathered.  A key with any
    number of parts therefore gathers at most about ``limit`` characters.
    """
    pieces = parts.select(
        key, order, F.substring(text, 1, limit + 1).alias("_text"),
        F.coalesce(F.length(text), F.lit(0)).alias("_size"),
    )
    near = running_before(
        pieces,
        [key],
        [order],
        F.floor(F.col(order) / chunk),
        {"_start": F.col("_size") + len(SEPARATOR)},
        at_most=limit + len(SEPARATOR),
    )
    piece = F.struct(F.col(order).alias("_o"), F.col("_text").alias("_t"))
    gathered = near.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    joined = F.array_join(F.col("_pieces").getField("_t"), SEPARATOR)
    return gathered.select(key, cap_context(joined, limit).alias("content"))


def diff_part(diff: Column) -> Column:
    return F.concat(F.lit("=== PR DIFF ===\n"), F.trim(diff))


def file_part(name: Column, content: Column) -> Column:
    body = F.coalesce(content, F.lit(fixed.UNREADABLE_FILE))
    return F.concat(F.lit("=== FILE: "), name, F.lit(" ===\n"), body)


def review_payload(label: Column, context: Column, prompt: Column, content: Column) -> Column:
    """The fixed seven-part review text."""
    return F.concat_ws(
        SEPARATOR,
        F.lit(fixed.REVIEW_INSTRUCTION),
        F.concat(F.lit("Selected guidance: "), label),
        F.lit("Guidance details:"),
        F.coalesce(F.nullif(context, F.lit("")), F.lit(fixed.NO_CONTEXT)),
        F.lit("Additional user prompt:"),
        F.coalesce(F.nullif(prompt, F.lit("")), F.lit(fixed.NO_PROMPT)),
        F.lit("Code/PR content:"),
        content,
    )


class Rule(NamedTuple):
    """One review rule; ``pattern`` is a Java regular expression."""

    rule_id: str
    category_id: str
    description: str
    pattern: str
    risk_level: str
    advice: str


def rule_scan(texts: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Security findings per text in the review format.

    The rule table is small and fixed, so it is compiled into one projection: no join
    and no shuffle, whatever the number of texts.
    """
    matched = texts.select(
        key,
        *[
            F.regexp_extract(F.col(text), rule.pattern, 0).alias(f"_evidence_{n}")
            for n, rule in enumerate(rules)
        ],
    )
    hits = []
    for n, rule in enumerate(rules):
        evidence = F.col(f"_evidence_{n}")
        finding = F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.category_id).alias("category_id"),
            F.lit(rule.description).alias("description"),
            F.lit(rule.risk_level).alias("risk_level"),
            evidence.alias("evidence"),
            F.lit(rule.advice).alias("advice"),
        )
        hits.append(F.when(evidence != "", finding))
    found = matched.select(key, F.array_compact(F.array(*hits)).alias("findings"))
    levels = F.col("findings").getField("risk_level")
    return found.select(
        key,
        "findings",
        highest_level(levels).alias("highest_risk"),
        F.array_contains(levels, "high").alias("blocking"),
        F.array_distinct(F.col("findings").getField("advice")).alias("recommendations"),
    )


def finding_rows(scanned: DataFrame, key: str) -> DataFrame:
    return scanned.select(key, F.posexplode("findings").alias("n", "f")).select(
        key, (F.col("n") + 1).alias("finding_no"), "f.*"
    )


def _parsed(reviews: DataFrame, raw: str, category_list: str) -> DataFrame:
    """Adds the parsed review and its keys; texts that are no JSON object have none."""
    none = F.array().cast("array<string>")
    return reviews.withColumns(
        {
            "_review": F.from_json(raw, schemas.security_review(category_list)),
            "_keys": F.coalesce(F.json_object_keys(raw), none),
        }
    )


def guardrail_fix(reviews: DataFrame, raw: str, category_list: str = "categories") -> DataFrame:
    """Adds ``ok``, ``reason`` and ``fixed``: a wrong highest risk is repaired.

    A missing vulnerability list or a bad (also a null) level is rejected.
    """
    rows = _parsed(reviews, raw, category_list)
    levels = F.transform(
        F.coalesce("_review.security_vulnerabilities", F.array()),
        lambda v: F.lower(F.coalesce(v["risk_level"], F.lit(""))),
    )
    valid = F.array(*[F.lit(x) for x in fixed.RISK_LEVELS])
    rows = rows.withColumn("_levels", levels)
    rows = rows.withColumn(
        "_bad", F.get(F.filter("_levels", lambda x: ~F.array_contains(valid, x)), 0)
    )
    actual = highest_level(F.col("_levels"))
    stated = F.lower(F.coalesce("_review.highest_risk", F.lit("")))
    repaired = F.when(
        actual.isNotNull() & (stated != actual),
        F.col("_review").withField("highest_risk", actual),
    ).otherwise(F.col("_review"))
    reason = (
        F.when(F.size("_keys") == 0, "missing_json")
        .when(~F.array_contains("_keys", "security_vulnerabilities"), "missing_list")
        .when(F.col("_bad").isNotNull(), F.concat(F.lit("bad_level:"), "_bad"))
    )
    return rows.withColumn("reason", reason).select(
        *reviews.columns,
        F.col("reason").isNull().alias("ok"),
        "reason",
        F.when(F.col("reason").isNull(), repaired).alias("fixed"),
    )


def guardrail_strict(reviews: DataFrame, raw: str, category_list: str = "categories") -> DataFrame:
    """Adds ``ok`` and ``reason``: a wrong or missing highest risk is rejected."""
    rows = _parsed(reviews, raw, category_list)
    stated = F.lower("_review.highest_risk")
    valid = F.array(*[F.lit(x) for x in fixed.RISK_LEVELS])
    levels = F.transform(
        F.coalesce("_review.security_vulnerabilities", F.array()), lambda v: v["risk_level"]
    )
    rows = rows.withColumns({"_stated": stated, "_levels": levels})
    bad = F.filter(
        "_levels", lambda x: ~F.coalesce(F.array_contains(valid, F.lower(x)), F.lit(False))
    )
    actual = highest_level(F.transform("_levels", F.lower))
    reason = (
        F.when(F.size("_keys") == 0, "missing_json")
        .when(F.coalesce("_stated", F.lit("")) == "", "missing_highest")
        .when(~F.array_contains(valid, F.col("_stated")), "bad_highest")
        .when(F.size(bad) > 0, F.concat(F.lit("bad_level:"), F.coalesce(F.get(bad, 0), F.lit(""))))
        .when(F.col("_stated") != actual, "other_highest")
    )
    return rows.withColumn("reason", reason).select(
        *reviews.columns, F.col("reason").isNull().alias("ok"), "reason"
    )


def decision_ok(text: Column, words: Sequence[str] = fixed.DECISIONS) -> Column:
    """Does the text name one of the decisions (as a substring)?"""
    return contains_any(F.lower(text), words)


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the predicates that do not hold for a row."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    )


def apply_hooks(rows: DataFrame, *hooks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Input hooks in order; each is a DataFrame step (a scorer may use a Pandas UDF)."""
    for hook in hooks:
        rows = rows.transform(hook)
    return rows


def route_change(errors: Column, answer: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(errors), F.lit(0)) > 0, "ERROR")
        .when(F.upper(answer).contains("COMPLEX"), "COMPLEX")
        .otherwise("SIMPLE")
    )


def decide(
    confidence: Column, blocking: Column, highest: Column, limit: int = fixed.APPROVAL_CONFIDENCE
) -> Column:
    return (
        F.when(F.coalesce(blocking, F.lit(False)) | (F.coalesce(highest, F.lit("")) == "high"), "escalate")
        .when(confidence > limit, "approve")
        .otherwise("request changes")
    )


def review_fan_in(quality: DataFrame, security: DataFrame, key: str) -> DataFrame:
    """Both results of a review side by side; a summary needs both."""
    return quality.join(security, key, "inner")


def fix_lines(fixes: Column) -> Column:
    def lines(fix: Column) -> Column:
        return F.array(
            F.concat(F.lit("- **"), F.coalesce(fix["description"], F.lit("")), F.lit("**")),
            F.concat(F.lit("  - Solution: "), F.coalesce(fix["solutions"], F.lit(""))),
            F.concat(F.lit("  - Explanation: "), F.coalesce(fix["explanation"], F.lit(""))),
        )

    return F.flatten(F.transform(fixes, lines))


def render_report(
    generated: Column, guidance: Column, findings: Column, confidence: Column, fixes: Column,
    recommendations: Column,
) -> Column:
    """Markdown report; ``generated`` is an ISO text."""

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    head = F.array(
        F.lit("# Code Review Report"), F.lit(""),
        F.concat(F.lit("Generated: "), generated),
        F.concat(F.lit("Selected guidance: "), guidance), F.lit(""),
        F.lit("## Findings"), shown(findings), F.lit(""),
        F.lit("## Confidence"), shown(confidence), F.lit(""),
        F.lit("## Fixes"),
    )
    tail = F.array(F.lit(""), F.lit("## Recommendations"), shown(recommendations))
    body = F.coalesce(fix_lines(fixes), F.array().cast("array<string>"))
    return F.array_join(F.concat(head, body, tail), "\n")


def parse_reports(reports: DataFrame) -> DataFrame:
    """Facts of stored reports ``(file_name, content)``; the guidance line may be absent."""
    content = F.col("content")

    def line(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(content, f"(?md){pattern}", 1), F.lit(""))

    fixes = F.regexp_extract(content, r"(?s)\n## Fixes\n(.*?)\n## Recommendations", 1)
    return reports.select(
        "file_name",
        report_timestamp(F.col("file_name")).alias("generated_at"),
        line(r"^Selected guidance: (.*)$").alias("guidance"),
        line(r"^## Confidence\n(\d+)$").try_cast("int").alias("confidence"),
        F.regexp_count(fixes, F.lit(r"(?m)^- \*\*")).alias("fix_count"),
    )


def review_trends(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    return parsed.groupBy(*by).agg(
        F.count("*").alias("reviews"),
        F.round(F.avg("confidence"), 2).alias("avg_confidence"),
        F.sum("fix_count").alias("fixes"),
    )


def token_use(states: DataFrame) -> DataFrame:
    return states.select(
        "id", F.col("tokens_used.total_tokens").alias("total_tokens"),
        F.col("tokens_used.successful_requests").alias("requests"),
    )
