"""Counts, matrices, detail lists and context texts over risk tables.

Risk rows are ``(sheet_id, risk_no, risk_id, title, severity, icon, description,
types, impacts, mitigations, examples)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.classify import severity_icon
from beaconry.functions.text import truncate
from beaconry.operators.firsts import first_per_key, last_per_key, top_per_key


def overview_metrics(
    rows: DataFrame, level: str, levels: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Total and one count per named level."""
    counts = [
        F.count_if(F.col(level) == name).alias(f"n_{name.lower().replace(' ', '_')}")
        for name in levels
    ]
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *counts)


def distribution(rows: DataFrame, level: str) -> DataFrame:
    """Rows per level, most frequent first."""
    return rows.groupBy(level).agg(F.count("*").alias("n")).orderBy(F.desc("n"), level)


def risk_matrix(risks: DataFrame) -> DataFrame:
    return risks.select(
        "sheet_id",
        "risk_id",
        "title",
        F.coalesce("severity", F.lit(fixed.DEFAULT_SEVERITY)).alias("severity"),
        F.coalesce(F.size("impacts"), F.lit(0)).alias("impact_count"),
        F.coalesce(F.size("mitigations"), F.lit(0)).alias("mitigation_count"),
    )


def by_category(rows: DataFrame, column: str, selected: str) -> DataFrame:
    """Equality filter; "All" keeps every row."""
    return rows if selected == "All" else rows.filter(F.col(column) == selected)


def categories(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def examples_with_risk(examples: DataFrame, risks: DataFrame) -> DataFrame:
    """Examples with severity and icon of the first risk of the same id, or defaults."""
    first = first_per_key(
        risks.select("sheet_id", "risk_id", "risk_no", "severity", "icon"),
        ["sheet_id", "risk_id"],
        ["risk_no"],
    ).drop("risk_no")
    return examples.join(first, ["sheet_id", "risk_id"], "left").withColumns(
        {
            "severity": F.coalesce("severity", F.lit(fixed.DEFAULT_SEVERITY)),
            "icon": F.coalesce("icon", F.lit(fixed.DEFAULT_RISK_ICON)),
        }
    )


def examples_inner_risk(
    examples: DataFrame, risks: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Examples joined to their risk, and the examples whose risk is missing."""
    return (
        examples.join(risks, list(keys), "inner"),
        examples.join(risks.select(*keys), list(keys), "left_anti"),
    )


def risk_list(risks: DataFrame, count: int = 3) -> DataFrame:
    """First impacts and mitigations of every risk, or a fallback text."""

    def shown(name: str, default: str) -> Column:
        array = F.coalesce(name, F.array().cast("array<string>"))
        return F.when(F.size(array) == 0, F.array(F.lit(default))).otherwise(
            F.slice(array, 1, count)
        )

    return risks.select(
        "sheet_id", "risk_no", "risk_id", "title", "severity", "description",
        shown("impacts", fixed.NO_IMPACTS).alias("impacts"),
        shown("mitigations", fixed.NO_MITIGATIONS).alias("mitigations"),
    )


def risk_cards(risks: DataFrame, limit: int | None = 6) -> DataFrame:
    """Icon, label, severity mark and short description of the first risks of a sheet."""
    chosen = risks
    if limit is not None:
        chosen = top_per_key(risks, ["sheet_id"], [F.col("risk_no")], limit).drop("rank")
    return chosen.select(
        "sheet_id",
        "risk_no",
        F.concat_ws(" ", "icon", F.concat_ws(": ", "risk_id", "title")).alias("label"),
        F.concat_ws(" ", severity_icon(F.col("severity")), "severity").alias("severity"),
        truncate(F.col("description"), fixed.CARD_CHARS).alias("description"),
    )


def risk_detail(risks: DataFrame, label: str) -> DataFrame:
    """Ordered detail rows of the risk labelled ``"id: title"``, of every sheet that has one.

    Labels are unique inside a sheet only; of equal ones the last risk counts.
    """
    labelled = risks.filter(F.concat_ws(": ", "risk_id", "title") == label)
    chosen = last_per_key(
        labelled.select("sheet_id", "risk_no", "risk_id", *fixed.DETAIL_HINTS), ["sheet_id"], ["risk_no"]
    )

    def items(kind: str, hint: str) -> Column:
        def item(value: Column) -> Column:
            named = kind == "types"
            return F.struct(
                (value["name"] if named else value).alias("text"),
                (value["descr"] if named else F.lit(None).cast("string")).alias("descr"),
            )

        nothing = F.struct(F.lit(hint).alias("text"), F.lit(None).cast("string").alias("descr"))
        listed = F.when(F.size(kind) > 0, F.transform(kind, item)).otherwise(F.array(nothing))
        numbered = F.transform(listed, lambda x, n: F.struct((n + 1).alias("item_no"), x["text"].alias("text"), x["descr"].alias("descr")))
        return F.transform(numbered, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))

    every = F.concat(*[items(kind, hint) for kind, hint in fixed.DETAIL_HINTS.items()])
    return chosen.select("sheet_id", "risk_id", F.inline(every)).select(
        "sheet_id", "risk_id", "kind", "item.*"
    )


def guidance_context(risks: DataFrame, headers: Column, limit: int = 10, advice: int = 3) -> DataFrame:
    """One context text per sheet: header lines, then its first risks with mitigations."""
    ranked = top_per_key(risks, ["sheet_id"], [F.col("risk_no")], limit)
    head = F.concat(
        F.lit("- "), "risk_id", F.lit(": "), F.coalesce("title", F.lit("")),
        F.lit(" (Severity: "), F.coalesce("severity", F.lit(fixed.DEFAULT_SEVERITY)), F.lit(")"),
    )
    bullets = F.transform(
        F.slice(F.coalesce("mitigations", F.array().cast("array<string>")), 1, advice),
        lambda m: F.concat(F.lit("  - Mitigation: "), m),
    )
    lines = F.concat(F.array(head), bullets)
    body = F.flatten(
        F.array_sort(F.collect_list(F.struct("rank", lines.alias("lines")))).getField("lines")
    )
    return ranked.groupBy("sheet_id", headers.alias("_headers")).agg(body.alias("_body")).select(
        "sheet_id", F.array_join(F.concat("_headers", "_body"), "\n").alias("context")
    )


def coverage_grid(
    findings: DataFrame, key: str, category: str, rank: Column, grid: Sequence[str]
) -> DataFrame:
    """Every category of a fixed grid for every key, with status and evidence count.

    ``rank`` is 0, 1 or 2 for not observed, needs attention, confirmed.  The grid is
    part of the expression, so the key's rows are aggregated once and then unfolded.
    """
    per_category = [
        F.struct(
            F.lit(name).alias("category"),
            F.coalesce(F.max(F.when(F.col(category) == name, rank)), F.lit(0)).alias("level"),
            F.count_if(F.col(category) == name).alias("evidence_count"),
        )
        for name in grid
    ]
    cells = findings.groupBy(key).agg(F.array(*per_category).alias("cells"))
    statuses = F.array(*[F.lit(s) for s in fixed.COVERAGE_STATUSES])
    return cells.select(key, F.inline("cells")).select(
        key, "category", F.get(statuses, F.col("level")).alias("status"), "evidence_count"
    )


def highest_level(levels: Column, order: Sequence[str] = tuple(fixed.RISK_LEVELS)) -> Column:
    """Highest level present in an array of lower-case levels; null if none is."""
    ranked = F.array(*[F.lit(x) for x in reversed(order)])
    return F.get(F.filter(ranked, lambda x: F.array_contains(levels, x)), 0)


def highest_per_key(rows: DataFrame, keys: Sequence[str], level: str, order: Sequence[str]) -> DataFrame:
    """Highest level per key from a maximum of ranks (combines on the map side)."""
    names = F.array(*[F.lit(x) for x in order])
    position = F.array_position(names, F.lower(level))
    best = F.max(F.when(position > 0, position))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.get(names, (F.col("_best") - 1).cast("int")).alias("highest")
    )
