"""Scans by a table of review rules: a text only meets rules whose rarest literal gram it holds.

Every rule gets one gram of three bytes that each of its matches must contain (ASCII, lower case),
or none if its pattern promises no such literal. One pass over the bytes of a text finds the grams
of the index in it by table look-up, whatever the number of rules; the rules of those grams
are joined by gram where the text is and their full patterns decide. Which gram of a rule is taken only
changes how many candidates there are, so counts of a small sample choose it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.plans.metrics import highest_level

GRAM = 3
#: Gram number of rules that every text meets.
ANY_TEXT = -1
#: Texts whose grams are counted to find the rarest of a rule.
SAMPLE_ROWS = 1_000
#: Bytes of texts whose grams are formed at a time.
SLICE_BYTES = 1 << 21

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_QUANTIFIERS = "?*{+"


def _skip(pattern: str, at: int) -> int:
    """Place behind the class or group that opens at ``at``."""
    if pattern[at] == "[":
        at += 2 if pattern[at + 1 : at + 2] != "^" else 3  # a leading ] is a member
        while at < len(pattern) and pattern[at] != "]":
            at += 2 if pattern[at] == "\\" else 1
        return at + 1
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = _skip(pattern, at) - 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at + 1
        at += 1
    return at


def required_literals(pattern: str) -> list[str]:
    """ASCII runs, in lower case, that every match of a Java pattern contains.

    Only plain characters outside of groups and classes count; a pattern with an alternative at
    its top, quoting, comments or escapes of several characters promises nothing.
    """
    flags = "".join(re.findall(r"\(\?([A-Za-z-]+)", pattern))
    if "\\Q" in pattern or set("x-") & set(flags):
        return []
    folded = "ks" if set("uU") & set(flags) else ""  # they also stand for signs beyond ASCII
    runs, run, at = [], "", 0
    while at < len(pattern):
        c, literal = pattern[at], None
        if c == "|":
            return []
        if c in "([":
            after = _skip(pattern, at)
        elif c == "\\":
            after = at + 2
            escaped = pattern[at + 1 : after]
            if escaped and not escaped.isalnum():
                literal = escaped
            elif escaped in ("x", "u", "p", "P", "k", "c", "N", "0"):
                return []
        else:
            after = at + 1
            if c not in ".^$)]}" and c not in _QUANTIFIERS:
                literal = c
        quantifier = pattern[after : after + 1]
        if literal is not None and literal.isascii() and literal.lower() not in tuple(folded) and quantifier not in ("?", "*", "{"):
            run += literal.lower()
            if quantifier == "+":
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
        at = after
        while quantifier and quantifier in _QUANTIFIERS:
            at = pattern.index("}", at) + 1 if quantifier == "{" and "}" in pattern[at:] else at + 1
            quantifier = pattern[at : at + 1]
    return [r for r in [*runs, run] if r]


def _grams(literal: str) -> set[int]:
    data = literal.encode()
    return {data[k] | data[k + 1] << 8 | data[k + 2] << 16 for k in range(len(data) - GRAM + 1)}


def text_grams(texts: DataFrame, text: str, wanted: Iterable[int]):
    """Column with the distinct wanted grams of each text; :data:`ANY_TEXT` is in every one."""
    codes = np.array(sorted(g for g in wanted if g >= 0), np.uint32)

    def in_rows(data: np.ndarray, ends: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Distinct row << 24 | gram of the texts between ``ends``."""
        data = _LOWER[data[ends[0] : ends[-1]]]
        if len(data) < GRAM:
            return np.zeros(0, np.int64)
        ends = ends - ends[0]
        wide = data.astype(np.uint32)
        code = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
        at = np.flatnonzero(known[code])
        row = np.searchsorted(ends, at, side="right") - 1
        inside = at + GRAM <= ends[row + 1]
        return np.unique(row[inside] << 24 | code[at[inside]].astype(np.int64))

    @F.arrow_udf("array<int>")
    def found(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        known = np.zeros(1 << 24, bool)
        known[codes] = True
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        cuts = np.unique([0, *(np.flatnonzero(np.diff((ends - ends[0]) // SLICE_BYTES)) + 1), len(column)])
        keys = np.concatenate([in_rows(data, ends[a : b + 1], known) + (int(a) << 24) for a, b in zip(cuts, cuts[1:])])
        rows = np.concatenate([keys >> 24, np.arange(len(column))])
        values = np.concatenate([(keys & 0xFFFFFF), np.full(len(column), ANY_TEXT)]).astype(np.int32)
        order = np.argsort(rows, kind="stable")
        starts = np.searchsorted(rows[order], np.arange(len(column) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(values[order]))

    return found(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def rule_index(rules: DataFrame, texts: DataFrame, text: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rules`` with ``gram``: the gram of each rule that the fewest texts of a sample hold, and
    ``literal``: the longest text in lower case that each of its matches contains.

    Rules are configuration: their ids and patterns pass through the driver once.
    """
    spark = rules.sparkSession
    patterns = rules.select("rule_id", "pattern").collect()
    literals = {r.rule_id: required_literals(r.pattern) for r in patterns}
    choices = {k: set().union(*map(_grams, v)) for k, v in literals.items()}
    every = set().union(*choices.values())
    sample = texts.select(text).limit(sample_rows)
    held = sample.select(F.explode(text_grams(sample, text, every)).alias("gram")).groupBy("gram").count()
    seen = {r["gram"]: r["count"] for r in held.collect()}
    chosen = [
        (k, min(v, key=lambda g: (seen.get(g, 0), g)) if v else ANY_TEXT, max(literals[k], key=len, default=""))
        for k, v in choices.items()
    ]
    kind = rules.schema["rule_id"].dataType.simpleString()
    return rules.join(spark.createDataFrame(chosen, f"rule_id {kind}, gram int, literal string"), "rule_id")


def rule_table_scan(texts: DataFrame, key: str, text: str, rules: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """What :func:`beaconry.plans.review.rule_scan` gives, for a table of rules.

    ``rules`` has the fields of ``review.Rule``, with unique ids; findings of a text are in the order
    of the ids. ``key`` is unique. Texts meet rules in a join by gram that broadcasts the rules, which are
    configuration: a text stands in a row for each of its grams, and those rows must not be shuffled.
    Before its pattern runs, a rule's literal must stand in the text, in lower case (which keeps ASCII
    neighbours). Only key and finding of what is left are grouped and shuffled.
    """
    index = rule_index(rules, texts, text, sample_rows)
    grams = [r.gram for r in index.select("gram").distinct().collect()]
    met = (
        texts.select(F.col(key), F.col(text).alias("_text"), F.lower(text).alias("_lower"), text_grams(texts, text, grams).alias("_grams"))
        .select(key, "_text", "_lower", F.explode("_grams").alias("gram"))
        .join(F.broadcast(index), "gram", "left")
        .filter((F.col("gram") == ANY_TEXT) | F.contains("_lower", "literal"))
    )
    pattern = F.coalesce("pattern", F.lit("(?!)"))
    evidence = F.call_function("regexp_extract", F.col("_text"), pattern, F.lit(0))
    finding = F.struct("rule_id", "category_id", "description", "risk_level", F.col("_evidence").alias("evidence"), "advice")
    found = met.withColumn("_evidence", evidence).drop("_text", "_lower").groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_evidence") != "", finding))).alias("findings")
    )
    levels = F.col("findings").getField("risk_level")
    return found.select(
        key,
        "findings",
        highest_level(levels).alias("highest_risk"),
        F.array_contains(levels, "high").alias("blocking"),
        F.array_distinct(F.col("findings").getField("advice")).alias("recommendations"),
    )
