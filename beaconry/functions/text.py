"""Text rules as Column expressions (all of them stay inside the JVM).

Patterns use ``(?U)`` so that ``\\s`` follows Unicode, and ``(?d)`` where ``.``
and ``$`` must treat only ``\\n`` as a line end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed

WORD = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True if any word is a substring; ``text`` must already be lower-cased."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def contains_any_word(text: Column, words: Sequence[str]) -> Column:
    """Like :func:`contains_any`, but only whole words count."""
    alternatives = "|".join(f"\\Q{w}\\E" for w in words)
    return text.rlike(f"(?<![{WORD}])(?:{alternatives})(?![{WORD}])")


def clean_title(text: Column, site: str | None = None) -> Column:
    """Title without heading marks, a trailing kind word, and what a dash and the name of ``site`` begin."""
    out = F.regexp_replace(text, r"(?U)\s*¶\s*", " ")
    if site:
        out = F.regexp_replace(out, rf"(?iUd)\s*[-–]\s*\Q{site}\E.*$", "")
    out = F.regexp_replace(out, "(?iUd)" + fixed.TITLE_KIND_SUFFIX, "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def slugify(text: Column) -> Column:
    """Lower-case, keep letters, digits and hyphens, join words with one hyphen."""
    out = F.regexp_replace(F.lower(text), rf"(?U)[^{WORD}\s-]", "")
    out = F.regexp_replace(out, r"(?U)[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", "")


def slugify_ascii(text: Column, default: str) -> Column:
    """ASCII-only slug of at most 80 characters for file names.

    A longer one ends with a hash of the whole, so names that begin alike stay apart.
    """
    out = F.regexp_replace(F.lower(strip(text)), r"(?U)[^a-z0-9\s-]", "")
    out = F.regexp_replace(out, r"(?U)\s+", "-")
    head = F.left(out, F.lit(fixed.SLUG_CHARS - 9))
    cut = F.concat(head, F.lit("-"), F.left(F.md5(out), F.lit(8)))
    out = F.when(F.length(out) > fixed.SLUG_CHARS, cut).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower (whole text, not per word)."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def display_title(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def strip_bullet(line: Column) -> Column:
    """Remove one leading bullet or list number followed by white space."""
    return F.regexp_replace(line, r"(?U)^[\-*\d\.]+\s+", "")


def strip_list_marker(line: Column) -> Column:
    """Remove every leading bullet, digit, dot or parenthesis."""
    return F.regexp_replace(line, r"(?U)^[\-\*\•\d\.\)]+\s*", "")


def is_list_item(line: Column) -> Column:
    """A stripped line that starts with a bullet or a list number."""
    return line.rlike(r"(?U)^(?:[\-\*\•]|\d+[\.\)])\s+")


def truncate(text: Column, limit: int, suffix: str = "...", always: bool = False) -> Column:
    """Cut at ``limit`` characters; the suffix marks a cut (or is always added)."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(suffix))
    return cut if always else F.when(F.length(text) > limit, cut).otherwise(text)


def cap_context(
    text: Column, limit: int = fixed.REVIEW_CHAR_LIMIT, notice: str = fixed.TRUNCATION_NOTICE
) -> Column:
    return truncate(text, limit, notice)


def paragraph_role(
    text: Column,
    warnings: Sequence[str] = fixed.WARNING_MARKS,
    tips: Sequence[str] = fixed.TIP_MARKS,
) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, warnings), "warning")
        .when(contains_any(low, tips), "tip")
        .otherwise("content")
    )


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def is_code_line(bare: Column) -> Column:
    """Does a stripped line look like source code or data rather than prose?"""
    starts = reduce(lambda a, b: a | b, [bare.startswith(p) for p in fixed.CODE_LINE_PREFIXES])
    ends = reduce(lambda a, b: a | b, [bare.endswith(s) for s in fixed.CODE_LINE_SUFFIXES])
    data = bare.contains("=") & bare.contains('"') & bare.contains(":")
    assigned = bare.rlike(rf"(?U)^[{WORD}]+\s*[=:]\s*[\[\{{\"']")
    return starts | ends | data | assigned


def drop_code_lines(text: Column) -> Column:
    lines = F.transform(
        F.split(text, "\n"), lambda line: F.struct(line.alias("line"), strip(line).alias("bare"))
    )
    prose = F.filter(lines, lambda entry: ~is_code_line(entry["bare"]))
    return F.array_join(prose.getField("line"), "\n")


def clean_description(text: Column, default: str = fixed.EMPTY_DESCRIPTION) -> Column:
    """Prose without code blocks, inline code, bracketed data and code-like lines."""
    out = F.regexp_replace(text, r"(?s)```.*?```", "")
    out = F.regexp_replace(out, r"`[^`]+`", "")
    out = F.regexp_replace(out, r"\{[^}]*\}", "")
    out = drop_code_lines(F.regexp_replace(out, r"\[[^\]]*\]", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), " {2,}", " ")
    return F.when(text == "", F.lit("")).otherwise(
        bind(
            strip(out),
            lambda prose: F.when(
                F.length(prose) < fixed.MIN_DESCRIPTION_CHARS, F.lit(default)
            ).otherwise(prose),
        )
    )


def recommendations(
    text: Column,
    limit: int | None = 10,
    patterns: Sequence[str] = fixed.RECOMMENDATION_PATTERNS,
) -> Column:
    """Distinct recommendation sentences, ordered by pattern, then by position."""
    found = F.concat(
        *[F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(1)) for p in patterns]
    )
    kept = F.filter(found, lambda r: F.length(r) > fixed.MIN_RECOMMENDATION_CHARS)
    out = F.array_distinct(F.transform(kept, strip))
    return out if limit is None else F.slice(out, 1, limit)


def title_tags(title: Column) -> Column:
    """Capitalised words of more than three letters, lower-cased, with repeats."""
    words = F.regexp_extract_all(title, F.lit(rf"(?<![{WORD}])[A-Z][a-z]+(?![{WORD}])"), F.lit(0))
    return F.transform(F.filter(words, lambda w: F.length(w) > 3), F.lower)


def meta_keywords(content: Column) -> Column:
    parts = F.transform(F.split(content, ","), lambda k: F.lower(strip(k)))
    return F.filter(parts, lambda k: k != "")


def decode_lossy(content: Column) -> Column:
    """Binary to text; bytes that are not UTF-8 are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def head(array: Column, count: int | None) -> Column:
    """First ``count`` elements; all with ``None``."""
    return array if count is None else F.slice(array, 1, count)


def head_text(text: Column, chars: int | None) -> Column:
    """First ``chars`` characters; all with ``None``."""
    return text if chars is None else F.substring(text, 1, chars)


def list_items(text: Column, triggers: Sequence[str], limit: int | None) -> Column:
    """First ``limit`` (with ``None`` all) list items that follow a trigger line, folded inside the row.

    A line holding a trigger word opens a list and is not an item itself; a blank
    line or a ``#`` line closes it.  The fold keeps at most ``limit`` items, so its
    buffer is bounded; :func:`beaconry.operators.lines.list_item_rows` is the
    unbounded form for long texts.
    """

    def step(state: Column, line: Column) -> Column:
        wanted = line["listed"] & (F.length(line["item"]) > fixed.MIN_ITEM_CHARS)
        room = F.lit(True) if limit is None else F.size(state["items"]) < limit
        return F.struct(
            F.when(line["trigger"], True)
            .when(line["closes"], False)
            .otherwise(state["on"])
            .alias("on"),
            F.when(state["on"] & wanted & room, F.concat(state["items"], F.array(line["item"])))
            .otherwise(state["items"])
            .alias("items"),
        )

    def classified(bare: Column) -> Column:
        trigger = contains_any(F.lower(bare), triggers)
        listed = is_list_item(bare)
        return F.struct(
            trigger.alias("trigger"),
            (~trigger & listed).alias("listed"),
            (~listed & ((bare == "") | bare.startswith("#"))).alias("closes"),
            F.when(listed, strip_list_marker(bare)).otherwise("").alias("item"),
        )

    start = F.struct(
        F.lit(False).alias("on"), F.array().cast("array<string>").alias("items")
    )
    lines = F.transform(F.transform(F.split(text, "\n"), strip), classified)
    return F.aggregate(lines, start, step, lambda s: s["items"])
