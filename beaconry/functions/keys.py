"""Keys, content hashes, expiry and report names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed

REPORT_NAME = r"code_review_(\d{8}_\d{6})\.md"
STAMP = "yyyyMMdd_HHmmss"


def cache_key(identifier: Column) -> Column:
    """First 32 hex digits of SHA-256."""
    return F.substring(F.sha2(identifier, 256), 1, 32)


def content_hash(columns: Sequence[str]) -> Column:
    """First 16 hex digits of SHA-256 over the JSON of the columns in name order."""
    fields = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(fields, 256), 1, 16)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def expires_at(created_at: Column, days: int | None = None, is_index: bool = False) -> Column:
    """Creation time plus the given days, else the page or index default."""
    if days is None:
        days = fixed.INDEX_TTL_DAYS if is_index else fixed.PAGE_TTL_DAYS
    return created_at + F.make_dt_interval(F.lit(days))


def risk_id(sheet_title_slug: Column, ordinal: Column) -> Column:
    """Upper-cased six-character slug prefix plus a two-digit ordinal."""
    prefix = F.upper(F.left(sheet_title_slug, F.lit(6)))
    return F.concat(prefix, F.format_string("%02d", ordinal))


def report_name(generated_at: Column) -> Column:
    return F.concat(F.lit("code_review_"), F.date_format(generated_at, STAMP), F.lit(".md"))


def report_timestamp(file_name: Column) -> Column:
    stamp = F.regexp_extract(file_name, REPORT_NAME, 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(STAMP))
