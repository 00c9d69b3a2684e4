"""Scraped pages, crawl results and URL inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.functions.urls import host_of, path_of
from beaconry.operators.firsts import top_per_key

SCRAPE_FIELDS = {
    "page_id": "bigint",
    "url": "string",
    "success": "boolean",
    "html": "string",
    "markdown": "string",
    "metadata": "map<string,string>",
    "scraped_at": "double",
    "error": "string",
}


def normalise_pages(pages: DataFrame) -> DataFrame:
    """The full scrape record; absent columns become null, ``success`` true."""
    defaults = {"success": F.lit(True)}
    columns = [
        (F.col(name) if name in pages.columns else defaults.get(name, F.lit(None)))
        .cast(kind)
        .alias(name)
        for name, kind in SCRAPE_FIELDS.items()
    ]
    return pages.select(*columns)


def read_pages(spark: SparkSession, path: str, successful_only: bool = False) -> DataFrame:
    pages = normalise_pages(spark.read.parquet(path))
    return successful(pages) if successful_only else pages


def successful(pages: DataFrame) -> DataFrame:
    """Pages that were fetched and have a body."""
    body = F.greatest(
        F.length(F.coalesce("html", F.lit(""))), F.length(F.coalesce("markdown", F.lit("")))
    )
    return pages.filter(F.col("success") & (body > 0))


def path_filter(
    pages: DataFrame, include: str | None = None, exclude: str | None = None
) -> DataFrame:
    path = path_of(F.col("url"))
    if include is not None:
        pages = pages.filter(path.rlike(include))
    if exclude is not None:
        pages = pages.filter(~path.rlike(exclude))
    return pages


def explode_crawl(
    crawls: DataFrame,
    include: str | None = None,
    exclude: str | None = None,
    max_pages: int | None = 50,
) -> DataFrame:
    """Pages of crawl results ``(job_id, pages array<struct<page_id,url,...>>)``.

    Every job keeps its own first ``max_pages`` pages; ``None`` keeps all.
    """
    pages = crawls.select("job_id", F.inline("pages"))
    return first_pages(path_filter(pages, include, exclude), max_pages, ["job_id"])


def first_pages(
    pages: DataFrame, max_pages: int | None = 50, keys: Sequence[str] = ("job_id",)
) -> DataFrame:
    """The page limit of a crawl: the lowest page ids of each key; ``None`` keeps all."""
    if max_pages is None:
        return pages
    return top_per_key(pages, keys, [F.col("page_id")], max_pages, "_rank").drop("_rank")


def crawl_key(url, include: str | None, exclude: str | None, max_pages: int | None):
    """Snapshot identifier of a crawl; the path filters are part of it."""
    parts = [F.lit("crawl:"), url, F.lit(f":{max_pages}:{include or ''}:{exclude or ''}")]
    return F.concat(*parts)


def url_inventory(pages: DataFrame, host: str | None = None) -> DataFrame:
    """Distinct URLs with their host, optionally of one host only."""
    urls = pages.select("url").distinct().withColumn("host", host_of(F.col("url")))
    return urls if host is None else urls.filter(F.col("host") == host)
