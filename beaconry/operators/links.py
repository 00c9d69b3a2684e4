"""Anchor extraction over the element table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.text import strip
from beaconry.functions.urls import related_id, resolve_url
from beaconry.operators.sections import owned_elements


def anchors(elements: DataFrame) -> DataFrame:
    """``(page_id, pos, href, text)`` of links with a target and a text."""
    links = elements.filter("tag = 'a'").select(
        "page_id", "pos", F.col("attrs")["href"].alias("href"), "text"
    )
    return links.filter("href is not null and href != '' and text != ''")


def guidance_links(links: DataFrame, pattern: str = fixed.GUIDANCE_HREF) -> DataFrame:
    return links.filter(F.col("href").rlike(pattern))


def loose_links(links: DataFrame, word: str = fixed.LOOSE_WORD) -> DataFrame:
    named = F.lower("href").contains(word) | F.lower("text").contains(word)
    return links.filter(~F.col("href").startswith("#") & named)


def link_pattern_filter(links: DataFrame, pattern: str | None = None) -> DataFrame:
    """Links whose URL matches; no pattern keeps all."""
    return links if pattern is None else links.filter(F.col("href").rlike(pattern))


def distinct_per_page(links: DataFrame, value: Column, limit: int) -> DataFrame:
    """First ``limit`` distinct values per page by first occurrence: ``(page_id, rank, value)``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), value.alias("v"))))
    firsts = links.groupBy("page_id").agg(
        F.slice(F.array_distinct(ordered.getField("v")), 1, limit).alias("values")
    )
    exploded = firsts.select("page_id", F.posexplode("values").alias("n", "value"))
    return exploded.select("page_id", (F.col("n") + 1).alias("rank"), "value")


def related_edges(elements: DataFrame, pattern: str = fixed.RELATED_ID, limit: int = 5) -> DataFrame:
    """Edges from a page to the ids of the guidance pages it links to."""
    links = elements.filter("tag = 'a'").select(
        "page_id", "pos", related_id(F.col("attrs")["href"], pattern).alias("related_id")
    )
    found = links.filter("related_id is not null")
    return distinct_per_page(found, F.col("related_id"), limit).withColumnRenamed(
        "value", "related_id"
    )


def languages_by_url(elements: DataFrame, base: Column) -> DataFrame:
    """``(page_id, url, languages)`` from the images next to links in the main content.

    Main content is the first ``article``, else the first ``main``, else the page.
    The last link to a URL that has any image wins.
    """
    place = F.struct("pos", "last")
    roots = elements.filter("tag in ('article', 'main')").groupBy("page_id").agg(
        F.coalesce(F.min(F.when(F.col("tag") == "article", place)), F.min(place)).alias("main")
    )
    links = (
        elements.filter("tag = 'a'")
        .withColumn("href", F.col("attrs")["href"])
        .filter(F.col("href").rlike(fixed.LANGUAGE_HREF))
        .join(roots, "page_id", "left")
        .filter("main is null or (main.pos < pos and pos <= main.last)")
        .select(
            "page_id", F.col("parent").alias("root_pos"), F.col("parent_last").alias("root_last"),
            F.col("pos").alias("link_pos"), "href",
        )
    )
    images = owned_elements(elements, "img", links).filter("attrs['alt'] != ''")
    names = F.array_sort(
        F.collect_list(F.struct("pos", strip(F.col("attrs")["alt"]).alias("alt")))
    ).getField("alt")
    per_link = images.groupBy("page_id", "href", "link_pos").agg(
        F.concat_ws(", ", names).alias("languages")
    )
    return (
        per_link.withColumn("url", resolve_url(base, F.col("href")))
        .groupBy("page_id", "url")
        .agg(F.max_by("languages", "link_pos").alias("languages"))
    )
