"""Structured guidance sheets from pages: risks, attack examples, tags, assembly.

``page_id`` is the sheet key everywhere: slugs and risk ids repeat across pages.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.classify import (
    assess_severity, category_icon, category_of, is_attack_title, is_risk_text, looks_like_risk,
    severity_icon,
)
from beaconry.functions.keys import risk_id
from beaconry.functions.text import (
    clean_description, clean_title, head, head_text, list_items, meta_keywords, recommendations,
    slugify, title_tags,
)
from beaconry.operators import sections as sec


class Limits(NamedTuple):
    """How much of each list or text a sheet keeps; ``None`` keeps all."""

    impacts: int | None = 5
    mitigations: int | None = 7
    fallback_mitigations: int | None = 5
    examples: int | None = 3
    scenarios: int | None = 3
    tags: int | None = 10
    snippet_chars: int | None = fixed.SNIPPET_CHARS
    description_chars: int | None = fixed.DESCRIPTION_CHARS


class Rules(NamedTuple):
    """Dictionaries of a sheet; pass column functions with your own words where the defaults do not fit,
    such as ``functools.partial(assess_severity, keywords=...)``."""

    category: Callable[[Column, Column], Column] = category_of
    severity: Callable[[Column], Column] = assess_severity
    risk: Callable[[Column, Column], Column] = is_risk_text
    likely_risk: Callable[[Column, Column], Column] = looks_like_risk
    attack: Callable[[Column], Column] = is_attack_title
    impact_words: Sequence[str] = tuple(fixed.IMPACT_TRIGGERS)
    mitigation_words: Sequence[str] = tuple(fixed.MITIGATION_TRIGGERS)
    warning_words: Sequence[str] = tuple(fixed.WARNING_MARKS)
    tip_words: Sequence[str] = tuple(fixed.TIP_MARKS)
    #: Name that titles may carry behind a dash.
    site: str | None = None


def titles(elements: DataFrame, site: str | None = None) -> DataFrame:
    """``(page_id, title, id)``: the first h1, else the title element, else "Unknown"."""
    heads = elements.groupBy("page_id").agg(
        F.min_by("text", F.when(F.col("tag") == "h1", F.col("pos"))).alias("h1"),
        F.min_by("text", F.when(F.col("tag") == "title", F.col("pos"))).alias("named"),
    )
    title = clean_title(F.coalesce("h1", "named", F.lit("Unknown")), site)
    return heads.select("page_id", title.alias("title")).withColumn("id", slugify(F.col("title")))


def tag_list(category: Column, keywords: Column, title: Column, limit: int | None = 10) -> Column:
    """Category, page keywords and title words, without repeats."""
    none = F.array().cast("array<string>")
    words = F.concat(F.array(category), F.coalesce(keywords, none), title_tags(title))
    return head(F.array_distinct(words), limit)


def with_risks(sections: DataFrame, rules: Rules = Rules(), limits: Limits = Limits()) -> DataFrame:
    """Adds ``risk``, a struct or null, to ``(page_id, sheet_title, section_no, ...)`` rows.

    A page with sections but no risk gets one Medium risk from its first section.
    """
    title, content = F.col("title"), F.col("content")
    flagged = sections.withColumn(
        "_risk", rules.risk(title, content) | rules.likely_risk(title, content)
    )
    page = Window.partitionBy("page_id")
    kept = F.col("_risk") | (
        ~F.max("_risk").over(page) & (F.min("section_no").over(page) == F.col("section_no"))
    )
    is_risk, listed = F.col("_risk"), F.col("_listed")
    asked = flagged.withColumn("_kept", F.coalesce(kept, F.lit(False)))
    staged = asked.withColumns(
        {
            "_listed": F.when(is_risk, list_items(content, rules.mitigation_words, limits.mitigations)),
            "_severity": F.when(is_risk, rules.severity(content)).otherwise(
                F.lit(fixed.DEFAULT_SEVERITY)
            ),
        }
    )
    no_list = F.col("_kept") & (~is_risk | (F.size(listed) == 0))
    advised = staged.withColumn("_advice", F.when(no_list, recommendations(content, None)))
    number = F.when(is_risk, F.col("section_no")).otherwise(F.lit(1))
    none = F.array().cast("array<string>")
    snippets = F.transform(
        head(F.col("code_examples"), limits.examples), lambda e: head_text(e, limits.snippet_chars)
    )
    fields = {
        "risk_no": number,
        "risk_id": risk_id(slugify(F.col("sheet_title")), number),
        "title": F.when(is_risk, title).otherwise(F.col("sheet_title")),
        "severity": F.col("_severity"),
        "icon": F.when(is_risk, severity_icon(F.col("_severity"))).otherwise(
            F.lit(fixed.DEFAULT_RISK_ICON)
        ),
        "description": head_text(clean_description(content), limits.description_chars),
        "impacts": F.when(is_risk, list_items(content, rules.impact_words, limits.impacts)).otherwise(none),
        "mitigations": F.when(~is_risk, head(F.col("_advice"), limits.fallback_mitigations))
        .when(F.size(listed) > 0, listed)
        .otherwise(head(F.col("_advice"), limits.mitigations)),
        "examples": F.when(is_risk, snippets).otherwise(none),
    }
    risk = F.struct(*[value.alias(name) for name, value in fields.items()])
    return advised.select(*sections.columns, F.when(F.col("_kept"), risk).alias("risk"))


def risks(sections: DataFrame, rules: Rules = Rules(), limits: Limits = Limits()) -> DataFrame:
    """Risk rows ``(page_id, risk_no, risk_id, title, severity, ...)``."""
    return with_risks(sections, rules, limits).filter("risk is not null").select("page_id", "risk.*")


def page_findings(rules: Rules = Rules()) -> list[Column]:
    """Aggregates over :func:`with_risks` rows: ordered ``risks`` and ``attacks`` of a page."""
    attack = F.struct("section_no", "title", "content", "code_examples")
    shown = F.when(rules.attack(F.col("title")), attack)
    return [
        F.array_sort(F.collect_list("risk")).alias("risks"),
        F.array_sort(F.collect_list(shown)).alias("attacks"),
    ]


def first_named_risk(risk_array: Column, title: Column) -> Column:
    """First risk whose title is part of ``title``; else the first risk of the page."""
    named = F.filter(risk_array, lambda r: F.lower(title).contains(F.lower(r["title"])))
    return F.coalesce(F.get(named, 0), F.get(risk_array, 0))


def example_list(limits: Limits = Limits()) -> Column:
    """Attack demonstrations from ``risks`` and ``attacks``, else one scenario per risk."""

    def first_of(array: Column, default: str) -> Column:
        return F.coalesce(F.get(array, 0), F.lit(default))

    def example(**fields: Column) -> Column:
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    def shown(section: Column) -> Column:
        risk = first_named_risk(F.col("risks"), section["title"])
        return example(
            risk_id=risk["risk_id"],
            title=section["title"],
            goal=head_text(section["content"], limits.snippet_chars),
            attack_prompt=first_of(section["code_examples"], ""),
            impact=first_of(risk["impacts"], ""),
            mitigation=first_of(risk["mitigations"], ""),
        )

    def scenario(risk: Column) -> Column:
        return example(
            risk_id=risk["risk_id"],
            title=F.concat(risk["title"], F.lit(" Attack Scenario")),
            goal=F.concat(F.lit("Exploit "), F.lower(risk["title"]), F.lit(" vulnerability")),
            attack_prompt=first_of(risk["examples"], fixed.SCENARIO_PROMPT),
            impact=first_of(risk["impacts"], fixed.SCENARIO_IMPACT),
            mitigation=first_of(risk["mitigations"], fixed.SCENARIO_MITIGATION),
        )

    return F.when(F.size("attacks") > 0, F.transform("attacks", shown)).otherwise(
        F.transform(head(F.col("risks"), limits.scenarios), scenario)
    )


def attack_examples(sections: DataFrame, rules: Rules = Rules(), limits: Limits = Limits()) -> DataFrame:
    """Attack demonstrations of a page, or one scenario per risk (three at most)."""
    pages = with_risks(sections, rules, limits).groupBy("page_id").agg(*page_findings(rules))
    exploded = pages.select("page_id", F.posexplode(example_list(limits)).alias("n", "example"))
    return exploded.select("page_id", (F.col("n") + 1).alias("example_no"), "example.*")


def _record(risk: Column) -> Column:
    """A risk in the fields of ``schemas.RISK``."""
    same = ("title", "severity", "icon", "description")
    lists = ("impacts", "mitigations", "examples")
    return F.struct(
        risk["risk_id"].alias("id"),
        *[risk[k].alias(k) for k in same],
        F.array().cast("array<array<string>>").alias("types"),
        *[risk[k].alias(k) for k in lists],
        F.array().cast("array<string>").alias("references"),
    )


def parse_sheets(
    elements: DataFrame,
    pages: DataFrame,
    last_updated: str | None = None,
    rules: Rules = Rules(),
    limits: Limits = Limits(),
) -> DataFrame:
    """``page_id`` and the whole sheet record (``schemas.SHEET``) of each page.

    ``pages`` has page_id and url; its ``markdown``, where there is one, becomes the raw text.

    Heads, sections and contributors are three branches over the elements, joined by
    page.  Sections are then unfolded for the risk rules and folded again, the page's
    other columns riding on its first section.  Give an element table that is stored
    or cached and clustered by page: no branch shuffles it again.
    """
    marked = sec.sibling_marks(elements)
    none = F.array().cast("array<string>")
    section = F.struct(
        "section_no", "title", "content", "code_examples", "warnings", "tips", "subsections"
    )
    tops = sec.sections(marked, rules.warning_words, rules.tip_words, rules.site).groupBy("page_id").agg(
        F.array_sort(F.collect_list(section)).alias("sections")
    )
    raw = F.coalesce(F.col("markdown"), F.lit("")) if "markdown" in pages.columns else F.lit("")
    source = pages.select("page_id", "url", raw.alias("raw_markdown"))
    heads = (
        sec.page_heads(marked)
        .join(source, "page_id")
        .join(tops, "page_id", "left")
        .join(sec.contributors(marked), "page_id", "left")
        .withColumn("sheet_title", clean_title(F.coalesce("h1", "named", F.lit("Unknown")), rules.site))
    )
    page_columns = ["url", "raw_markdown", "intro", "keywords", "related_ids", "contributors", "sections"]
    unfolded = heads.select(
        "page_id",
        "sheet_title",
        F.struct(*page_columns).alias("page"),
        F.explode_outer("sections").alias("s"),
    ).select(
        "page_id",
        "sheet_title",
        F.when(F.coalesce("s.section_no", F.lit(1)) == 1, F.col("page")).alias("page"),
        *[F.col(f"s.{c}").alias(c) for c in ("section_no", "title", "content", "code_examples")],
    )
    folded = (
        with_risks(unfolded, rules, limits)
        .groupBy("page_id", "sheet_title")
        .agg(F.any_value("page", True).alias("page"), *page_findings(rules))
        .select("page_id", F.col("sheet_title").alias("title"), "page.*", "risks", "attacks")
        .withColumn("category", rules.category(F.col("title"), F.col("url")))
        .withColumn("attack_examples", example_list(limits))
    )
    return folded.select(
        "page_id",
        slugify(F.col("title")).alias("id"),
        "title",
        "url",
        head_text(F.col("intro"), limits.description_chars).alias("description"),
        "category",
        category_icon(F.col("category")).alias("icon"),
        F.col("intro").alias("introduction"),
        F.coalesce(
            F.transform("sections", lambda s: s.dropFields("section_no")), F.array()
        ).alias("sections"),
        F.transform("risks", _record).alias("risks"),
        "attack_examples",
        F.lit(last_updated).cast("string").alias("last_updated"),
        F.coalesce("contributors", none).alias("contributors"),
        F.col("related_ids").alias("related_cheatsheets"),
        tag_list(
            F.col("category"), meta_keywords(F.col("keywords")), F.col("title"), limits.tags
        ).alias("tags"),
        "raw_markdown",
    )
