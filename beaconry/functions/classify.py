"""Dictionary-driven classification.

Dictionaries are parameters of fixed, small size, so they are compiled into the
expression (``when`` chains and literal maps) instead of being joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.text import capitalize, contains_any, contains_any_word


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a fixed dictionary for ``key``, else ``default``."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def first_contained(text: Column, keys: Sequence[str]) -> Column:
    """The first key, in order, that is a substring of ``text``; null if none is."""
    out = F.when(text.contains(keys[0]), F.lit(keys[0]))
    for key in keys[1:]:
        out = out.when(text.contains(key), F.lit(key))
    return out


def category_of(
    title: Column,
    url: Column,
    keys: Sequence[str] = tuple(fixed.CATEGORY_ICONS),
    fallbacks: Sequence[tuple[str, Sequence[str]]] = tuple(fixed.CATEGORY_FALLBACKS),
    default: str = fixed.DEFAULT_CATEGORY,
) -> Column:
    text = F.lower(F.concat(title, F.lit(" "), url))
    second = F.lit(default)
    for name, words in reversed(fallbacks):
        second = F.when(contains_any(text, words), F.lit(name)).otherwise(second)
    return F.coalesce(capitalize(first_contained(text, keys)), second)


def category_icon(category: Column) -> Column:
    return lookup(F.lower(category), fixed.CATEGORY_ICONS, fixed.DEFAULT_CATEGORY_ICON)


def severity_icon(severity: Column) -> Column:
    return lookup(severity, fixed.SEVERITY_ICONS, fixed.DEFAULT_SEVERITY_ICON)


def severity_color(severity: Column) -> Column:
    return lookup(severity, fixed.SEVERITY_COLORS, fixed.DEFAULT_SEVERITY_COLOR)


def assess_severity(
    text: Column,
    keywords: Mapping[str, Sequence[str]] = fixed.SEVERITY_KEYWORDS,
    default: str = fixed.DEFAULT_SEVERITY,
    word_boundary: bool = False,
) -> Column:
    """First level, in order, with any of its words in the text."""
    match = contains_any_word if word_boundary else contains_any
    low = F.lower(text)
    out = F.lit(default)
    for level, words in reversed(keywords.items()):
        out = F.when(match(low, words), F.lit(level.capitalize())).otherwise(out)
    return out


def normalize_severity(severity: Column) -> Column:
    name = F.initcap(F.trim(severity))
    known = name.isin(*fixed.SEVERITY_ICONS)
    return F.coalesce(F.when(known, name), F.lit(fixed.DEFAULT_SEVERITY))


def is_risk_text(
    title: Column,
    content: Column,
    words: Sequence[str] = fixed.RISK_KEYWORDS,
    word_boundary: bool = False,
) -> Column:
    match = contains_any_word if word_boundary else contains_any
    return match(F.lower(title), words) | match(F.lower(content), words)


def term_count(text: Column, terms: Sequence[str] = fixed.SECURITY_TERMS) -> Column:
    """How many of the terms occur (each counts once)."""
    low = F.lower(text)
    total = F.lit(0)
    for term in terms:
        total = total + low.contains(term).cast("int")
    return total


def looks_like_risk(title: Column, content: Column) -> Column:
    return term_count(F.concat(title, F.lit(" "), content)) >= fixed.SECURITY_TERMS_NEEDED


def is_attack_title(title: Column, words: Sequence[str] = fixed.ATTACK_KEYWORDS) -> Column:
    return contains_any(F.lower(title), words)


def is_boilerplate_title(title: Column, words: Sequence[str] = fixed.BOILERPLATE_TITLES) -> Column:
    return contains_any(F.lower(title), words)
