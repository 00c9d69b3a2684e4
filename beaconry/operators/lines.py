"""Line tables and the line-by-line rules expressed as windows.

Documents are clustered by id before they are split, so the shuffle moves whole
texts once and every window or aggregation per document afterwards is local.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.text import (
    contains_any, is_list_item, strip, strip_bullet, strip_list_marker,
)

# Fixed value: every character sequence that ends a line of markdown.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def line_table(
    df: DataFrame, keys: Sequence[str], text: str, line_end: str = "\n", cluster: bool = True
) -> DataFrame:
    """``(keys, pos, line)``, one row per line."""
    source = df.select(*keys, text)
    if cluster:
        source = source.repartition(*keys)
    return source.select(*keys, F.posexplode(F.split(text, line_end)).alias("pos", "line"))


def list_item_rows(
    lines: DataFrame,
    keys: Sequence[str],
    triggers: Sequence[str],
    min_chars: int = fixed.MIN_ITEM_CHARS,
) -> DataFrame:
    """List items that follow a trigger line, up to a blank or ``#`` line."""
    bare = strip(F.col("line"))
    marked = lines.withColumn("_bare", bare).withColumns(
        {
            "_trigger": contains_any(F.lower("_bare"), triggers),
            "_listed": is_list_item(F.col("_bare")),
            "item": strip_list_marker(F.col("_bare")),
        }
    )
    closes = (F.col("_bare") == "") | F.col("_bare").startswith("#")
    event = F.when(F.col("_trigger"), True).when(closes & ~F.col("_listed"), False)
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = marked.withColumn("_on", F.last(event, ignorenulls=True).over(before)).filter(
        F.col("_on") & ~F.col("_trigger") & F.col("_listed") & (F.length("item") > min_chars)
    )
    return kept.select(*keys, "pos", "item")


def bucket_marks(
    lines: DataFrame,
    keys: Sequence[str],
    prefixes: Sequence[tuple[str, str]] = tuple(fixed.BUCKET_PREFIXES),
) -> DataFrame:
    """Adds ``bucket``, opened by the last line that starts with a bucket word.

    It is null for the opening lines themselves and for lines before the first one.
    """
    low = F.lower("line")
    opened = F.lit(None).cast("string")
    for prefix, bucket in reversed(prefixes):
        opened = F.when(low.startswith(prefix), F.lit(bucket)).otherwise(opened)
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_opened", opened)
    filled = F.last("_opened", ignorenulls=True).over(upto)
    return marked.withColumn("bucket", F.when(F.col("_opened").isNull(), filled)).drop("_opened")


def bucket_rows(
    lines: DataFrame,
    keys: Sequence[str],
    prefixes: Sequence[tuple[str, str]] = tuple(fixed.BUCKET_PREFIXES),
) -> DataFrame:
    """The lines that are in a bucket, without their bullets."""
    return bucket_marks(lines, keys, prefixes).filter("bucket is not null").select(
        *keys, "pos", "bucket", strip_bullet(F.col("line")).alias("line")
    )


def heading_fill(
    lines: DataFrame,
    keys: Sequence[str],
    pattern: str = r"^#{2,4}\s+(.+)$",
    start: str = "body",
) -> DataFrame:
    """Every stripped line with the heading it stands under; headings have ``is_heading``."""
    bare = strip(F.col("line"))
    heading = F.regexp_extract(F.col("line"), f"(?Ud){pattern}", 1)
    marked = lines.withColumn("line", bare).withColumn("is_heading", heading != "")
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("is_heading"), F.lower(strip(heading)))
    return marked.withColumn(
        "header", F.coalesce(F.last(header, ignorenulls=True).over(upto), F.lit(start))
    )


def header_buckets(filled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-empty lines per heading in first-seen order; a repeated heading appends."""
    body = ~F.col("is_heading") & (F.col("line") != "")
    entry = F.when(body, F.struct("pos", "line"))
    used = filled.filter(F.col("is_heading") | (F.col("line") != ""))
    return used.groupBy(*keys, "header").agg(
        F.min("pos").alias("first_pos"),
        F.array_sort(F.collect_list(entry)).getField("line").alias("lines"),
    )


def latest_headers(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per repeated heading the lines of its last non-empty occurrence, at its first place."""
    return (
        sections.filter(F.size("lines") > 0)
        .groupBy(*keys, "header")
        .agg(F.min("pos").alias("first_pos"), F.max_by("lines", "pos").alias("lines"))
    )


def headers_per_key(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All headings of one text as an ordered array (bounded by that one text)."""
    entry = F.struct("first_pos", "header", "lines")
    return buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("headers"))


def collect_by_keys(
    headers: Column, words: Sequence[str], clean: bool = True, limit: int | None = None
) -> Column:
    """Distinct lines under headings that contain a word: by word, heading, line."""

    def under(word: str) -> Column:
        found = F.filter(headers, lambda h: h["header"].contains(word))
        return F.flatten(F.transform(found, lambda h: h["lines"]))

    lines = F.concat(*[under(w) for w in words])
    if clean:
        lines = F.transform(lines, strip_bullet)
    out = F.array_distinct(F.filter(lines, lambda x: x != ""))
    return out if limit is None else F.slice(out, 1, limit)


def header_lines(headers: Column, name: str) -> Column:
    """First line under exactly this heading, or null."""
    found = F.filter(headers, lambda h: h["header"] == name)
    return F.get(F.get(found, 0)["lines"], 0)


def collect_all(headers: Column, keys: Mapping[str, Sequence[str]], clean: bool) -> dict:
    """The four lists of a risk page; types are capped at five and become pairs."""
    out = {
        name: collect_by_keys(headers, words, clean, 5 if name == "types" else None)
        for name, words in keys.items()
    }
    out["types"] = as_types(out["types"])
    return out


def as_types(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("").alias("descr")))
