"""URL rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.text import slugify, strip


def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def path_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; only touched when a path has any."""

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part == ".", kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    empty = F.array().cast("array<string>")
    closed = F.regexp_replace(path, r"(/\.{1,2})$", "$1/")
    folded = F.array_join(F.aggregate(F.split(closed, "/"), empty, step), "/")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), folded).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` as seen from ``base``."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(plain == origin, F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_replace(plain, r"[^/]*$", "")
    )
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(target) + 1, F.length(href))
    full_path = F.when(href.startswith("/"), target).otherwise(
        F.concat(F.substring(folder, F.length(origin) + 1, F.length(folder)), target)
    )
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(plain, href))
        .otherwise(F.concat(origin, _resolve_dots(full_path), rest))
    )


def id_from_url(href: Column, text: Column, pattern: str = fixed.GUIDANCE_ID) -> Column:
    """Id captured from the link, else the slug of its text."""
    raw = F.regexp_extract(href, pattern, 1)
    found = F.lower(F.replace(raw, F.lit("_"), F.lit("-")))
    return F.coalesce(F.nullif(found, F.lit("")), slugify(text))


def title_from_url(url: Column) -> Column:
    """Readable title from the last path segment."""
    name = F.element_at(F.split(path_of(url), "/"), -1)
    words = F.regexp_replace(F.replace(name, F.lit(".html"), F.lit("")), "[_-]", " ")
    return F.regexp_replace(words, r"(?iU)\s+Cheat\s+Sheet$", "")


def risk_number(text: Column, pattern: str = fixed.RISK_LABEL) -> Column:
    """Canonical id such as ``A03`` from a numbered label; null if there is none."""
    digits = F.regexp_extract(text, f"(?Ud){pattern}", 1)
    return F.when(digits != "", F.format_string("A%02d", digits.try_cast("int")))


def risk_label_title(text: Column, pattern: str = fixed.RISK_LABEL) -> Column:
    return strip(F.regexp_extract(text, f"(?Ud){pattern}", 2))


def related_id(href: Column, pattern: str = fixed.RELATED_ID) -> Column:
    """Id of the guidance page a link points to; null for other links."""
    raw = F.nullif(F.regexp_extract(href, pattern, 1), F.lit(""))
    return F.lower(F.replace(raw, F.lit("_"), F.lit("-")))
