"""Heading ownership over the element table.

A heading owns the *siblings* after it, up to the next heading that ends it.  One
window per sibling list (page, parent) marks, for every element, the last h2, the
last h2/h3 and the last ``h*`` sibling; sections, subsections and introductions
are then aggregations.  All groups are parts of one page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.classify import is_boilerplate_title
from beaconry.functions.text import clean_title, contains_any, head, paragraph_role
from beaconry.functions.urls import related_id


def _ordered(value: Column, field: str) -> Column:
    """Values of one group in document order; rows where ``value`` is null are skipped."""
    entry = F.when(value.isNotNull(), F.struct(F.col("pos"), value.alias(field)))
    return F.array_sort(F.collect_list(entry)).getField(field)


def sibling_marks(elements: DataFrame) -> DataFrame:
    """Adds ``h2``, ``h23`` and ``head``: the owning headings as structs, and ``next_pos``."""
    siblings = Window.partitionBy("page_id", "parent").orderBy("pos")
    upto = siblings.rowsBetween(Window.unboundedPreceding, 0)

    def last_heading(condition: Column) -> Column:
        heading = F.when(condition, F.struct("pos", "tag", "text", "single"))
        return F.last(heading, ignorenulls=True).over(upto)

    tag = F.col("tag")
    return elements.withColumns(
        {
            "h2": last_heading(tag == "h2"),
            "h23": last_heading(tag.isin("h2", "h3")),
            "head": last_heading(tag.startswith("h")),
            "prev_tag": F.lag("tag").over(siblings),
            "prev_raw": F.lag("raw").over(siblings),
        }
    )


def heading_body(elements: DataFrame, heading: str, body_tag: str) -> DataFrame:
    """Per heading of one tag: number and text length of the body elements it owns."""
    siblings = Window.partitionBy("page_id", "parent").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    owner = F.last(F.when(F.col("tag") == heading, F.col("pos")), ignorenulls=True).over(siblings)
    owned = elements.withColumn("heading_pos", owner).filter("heading_pos is not null")
    body = F.col("tag") == body_tag
    return owned.groupBy("page_id", "heading_pos").agg(
        F.count_if(body).alias("body_count"),
        F.coalesce(F.sum(F.when(body, F.length("text"))), F.lit(0)).alias("body_chars"),
    )


def _merged(lists: str, field: str) -> Column:
    """Values of several ordered lists of one section in document order."""
    return F.array_sort(F.flatten(F.collect_list(lists))).getField(field)


def sections(
    marked: DataFrame,
    warnings: Sequence[str] = fixed.WARNING_MARKS,
    tips: Sequence[str] = fixed.TIP_MARKS,
    site: str | None = None,
) -> DataFrame:
    """``(page_id, section_no, pos, title, content, code_examples, warnings, tips, subsections)``.

    Numbers count the kept sections of a page in document order.  Elements under an
    h3 belong to the section as well as to its subsection.  Elements are grouped by
    (h2, h3) first, and those parts by h2, all inside the page's own partition.
    """
    tag, none = F.col("tag"), F.array().cast("array<string>")
    text = F.when(tag.isin("div", "p"), F.col("text"))
    code = F.when(tag.isin("pre", "code"), F.col("raw"))
    sub_text = F.when(tag.isin("p", "div", "ul", "ol"), F.col("text"))
    role = paragraph_role(F.col("_text"), warnings, tips)
    h3 = F.when(F.col("h23.tag") == "h3", F.col("h23"))

    def listed(value: Column) -> Column:
        return F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("t"))))

    parts = (
        marked.filter("h2 is not null")
        .select(
            "page_id", "pos", "h2", h3.alias("h3"),
            text.alias("_text"), code.alias("_code"), sub_text.alias("_sub"),
        )
        .withColumn("_role", role)
        .groupBy("page_id", "h2", "h3")
        .agg(
            *[
                listed(F.when(F.col("_role") == r, F.col("_text"))).alias(r)
                for r in ("content", "warning", "tip")
            ],
            listed(F.col("_code")).alias("code"),
            listed(F.col("_sub")).alias("sub"),
        )
    )
    subsection = F.struct(
        F.col("h3.pos").alias("pos"),
        F.col("h3.text").alias("title"),
        F.array_join(F.array_sort("sub").getField("t"), "\n\n").alias("content"),
        F.array_sort("code").getField("t").alias("code_examples"),
        none.alias("warnings"),
        none.alias("tips"),
    )
    filled = F.col("h3").isNotNull() & ((F.size("sub") > 0) | (F.size("code") > 0))
    grouped = parts.groupBy("page_id", "h2").agg(
        F.array_join(_merged("content", "t"), "\n\n").alias("content"),
        _merged("code", "t").alias("code_examples"),
        _merged("warning", "t").alias("warnings"),
        _merged("tip", "t").alias("tips"),
        F.array_sort(F.collect_list(F.when(filled, subsection))).alias("subsections"),
    )
    titled = grouped.withColumn("title", clean_title(F.col("h2.text"), site)).filter(
        ~is_boilerplate_title(F.col("title"))
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("h2.pos"))
    named = F.transform(
        "subsections", lambda s: s.withField("title", clean_title(s["title"], site)).dropFields("pos")
    )
    return titled.select(
        "page_id", number.alias("section_no"), F.col("h2.pos").alias("pos"),
        "title", "content", "code_examples", "warnings", "tips", named.alias("subsections"),
    )


def section_tree(section_rows: DataFrame) -> DataFrame:
    """Sections and their subsections in one table with ``level`` and ``parent_no``."""
    body = ["title", "content", "code_examples", "warnings", "tips"]
    top = section_rows.select(
        "page_id", F.lit(2).alias("level"), F.lit(None).cast("int").alias("parent_no"),
        "section_no", *body,
    )
    low = section_rows.select("page_id", "section_no", F.posexplode("subsections").alias("n", "s"))
    return top.unionByName(
        low.select(
            "page_id", F.lit(3).alias("level"), F.col("section_no").alias("parent_no"),
            (F.col("n") + 1).alias("section_no"), *[F.col(f"s.{c}").alias(c) for c in body],
        )
    )


def introductions(
    marked: DataFrame,
    words: Sequence[str] = fixed.INTRO_HEADINGS,
    paragraphs: int = 3,
    chars: int = fixed.INTRO_CHARS,
) -> DataFrame:
    """Introductory text per page: under a heading, else the first paragraphs, cut.

    For every word only the first heading with that word counts; a word whose
    heading owns no element gives way to the next word.  One pass: elements are
    grouped by owning heading, then the headings by page.
    """
    return page_heads(marked, words, paragraphs, chars).select("page_id", "intro")


def page_heads(
    marked: DataFrame,
    words: Sequence[str] = fixed.INTRO_HEADINGS,
    paragraphs: int = 3,
    chars: int = fixed.INTRO_CHARS,
    related_limit: int | None = 5,
) -> DataFrame:
    """Introduction, ``h1`` and ``named`` (title element), keywords and related links per page."""
    tag = F.col("tag")
    low = F.when(F.col("head.tag").isin("h1", "h2", "h3"), F.lower("head.single"))
    asked = contains_any(F.col("low"), words)
    body = F.when(~tag.startswith("h") & asked, F.coalesce("text", F.lit("")))
    keywords = F.when(
        (tag == "meta") & (F.lower(F.col("attrs")["name"]) == "keywords"), F.col("attrs")["content"]
    )
    related = F.when(tag == "a", related_id(F.col("attrs")["href"]))

    def first(value: Column) -> Column:
        return F.min(F.when(value.isNotNull(), F.struct("pos", value.alias("v"))))

    owners = (
        marked.select(
            "page_id", "pos", "tag", "text", F.col("head.pos").alias("head_pos"), low.alias("low"),
            keywords.alias("keywords"), related.alias("related"),
        )
        .groupBy("page_id", "head_pos", "low")
        .agg(
            _ordered(body, "t").alias("parts"),
            F.slice(
                F.array_sort(F.collect_list(F.when(tag == "p", F.struct("pos", "text")))),
                1, paragraphs,
            ).alias("lead"),
            first(F.when(tag == "h1", F.col("text"))).alias("h1"),
            first(F.when(tag == "title", F.col("text"))).alias("named"),
            first(F.col("keywords")).alias("keywords"),
            F.collect_list(
                F.when(F.col("related").isNotNull(), F.struct("pos", "related"))
            ).alias("related"),
        )
        .withColumn("body", F.when(F.size("parts") > 0, F.array_join("parts", " ")))
    )
    leads = _merged("lead", "text")
    pages = owners.groupBy("page_id").agg(
        *[
            F.min_by(
                F.struct("body"), F.when(F.col("low").contains(word), F.col("head_pos"))
            ).alias(f"_{n}")
            for n, word in enumerate(words)
        ],
        F.substring(F.array_join(F.slice(leads, 1, paragraphs), " "), 1, chars).alias("lead"),
        *[F.min(c).getField("v").alias(c) for c in ("h1", "named", "keywords")],
        head(F.array_distinct(_merged("related", "related")), related_limit).alias("related_ids"),
    )
    bodies = [F.col(f"_{n}.body") for n in range(len(words))]
    return pages.select(
        "page_id", F.coalesce(*bodies, "lead", F.lit("")).alias("intro"),
        "h1", "named", "keywords", "related_ids",
    )


def holders(ranges: Column, pos: Column) -> Column:
    """Those of an array of ``(pos, last, ...)`` structs whose elements hold the element ``pos``."""
    return F.filter(ranges, lambda r: (r["pos"] < pos) & (pos <= r["last"]))


def owned_elements(elements: DataFrame, tag: str, roots: DataFrame) -> DataFrame:
    """Descendants of one tag joined to their root rows ``(page_id, root_pos, root_last, ...)``."""
    inner = elements.filter(F.col("tag") == tag).select("page_id", "pos", "text", "attrs")
    return inner.join(roots, "page_id").filter("root_pos < pos and pos <= root_last")


def contributors(
    marked: DataFrame, words: Sequence[str] = fixed.CONTRIBUTOR_MARKS, limit: int | None = 10
) -> DataFrame:
    """Up to ``limit`` (with ``None`` all) list entries of the element right after an author heading.

    The number ranges of such elements are attached to the page's rows by a window, so
    entries find the ranges that hold them without a join.
    """
    after_heading = F.col("prev_tag").isin("h2", "h3") & contains_any(F.lower("prev_raw"), words)
    page = Window.partitionBy("page_id")
    roots = F.collect_list(F.when(after_heading, F.struct("pos", "last"))).over(page)
    entries = (
        marked.withColumn("roots", roots)
        .filter("tag = 'li'")
        .select("page_id", "pos", "text", F.explode(holders(F.col("roots"), F.col("pos"))).alias("root"))
    )
    names = F.array_sort(
        F.collect_list(F.struct(F.col("root.pos").alias("root_pos"), "pos", "text"))
    ).getField("text")
    return entries.groupBy("page_id").agg(head(names, limit).alias("contributors"))
