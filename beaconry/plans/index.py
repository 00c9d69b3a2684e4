"""Indexes of guidance pages from link lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.classify import category_of
from beaconry.functions.text import clean_title
from beaconry.functions.urls import id_from_url, resolve_url
from beaconry.operators.firsts import first_per_key
from beaconry.operators.links import anchors, guidance_links, languages_by_url, loose_links

CATEGORY_KEYS = tuple(fixed.CATEGORY_ICONS)


def _entries(
    links: DataFrame,
    base: Column,
    id_pattern: str,
    title_first: bool,
    category_keys: Sequence[str],
) -> DataFrame:
    # Two steps, so that the cleaned title is computed once and not per category key.
    titled = links.select(
        "page_id", "pos", "href", "text", clean_title(F.col("text")).alias("title")
    )
    named = F.col("title") if title_first else F.col("text")
    return titled.select(
        "page_id",
        "pos",
        id_from_url(F.col("href"), F.col("text"), id_pattern).alias("id"),
        "title",
        resolve_url(base, F.col("href")).alias("url"),
        category_of(named, F.col("href"), category_keys).alias("category"),
    )


def index_entries(
    elements: DataFrame,
    base_url: str,
    pattern: str = fixed.GUIDANCE_HREF,
    id_pattern: str = fixed.GUIDANCE_ID,
    category_keys: Sequence[str] = CATEGORY_KEYS,
) -> DataFrame:
    """Every matching link of every index page, before duplicates are removed."""
    links = guidance_links(anchors(elements), pattern)
    base = F.lit(base_url.rstrip("/") + "/")
    return _entries(links, base, id_pattern, True, category_keys)


def loose_entries(
    elements: DataFrame,
    base_url: str,
    word: str = fixed.LOOSE_WORD,
    id_pattern: str = fixed.LOOSE_ID,
    category_keys: Sequence[str] = CATEGORY_KEYS,
) -> DataFrame:
    links = loose_links(anchors(elements), word)
    return _entries(links, F.lit(base_url), id_pattern, False, category_keys)


def first_per_url(entries: DataFrame) -> DataFrame:
    return first_per_key(entries, ["page_id", "url"], ["pos"])


def build_index(elements: DataFrame, base_url: str, **options) -> DataFrame:
    """Index per page: first link per URL, with languages, ordered by title."""
    unique = first_per_url(index_entries(elements, base_url, **options))
    languages = languages_by_url(elements, F.lit(base_url.rstrip("/") + "/"))
    return unique.join(languages, ["page_id", "url"], "left").orderBy(
        "page_id", F.lower("title"), "pos"
    )


def build_index_loose(elements: DataFrame, base_url: str, **options) -> DataFrame:
    return first_per_url(loose_entries(elements, base_url, **options))


def index_summary(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Unique URLs, and the sorted categories seen before duplicates were removed."""
    return entries.groupBy(*keys).agg(
        F.countDistinct("url").alias("total_count"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )
