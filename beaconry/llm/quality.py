"""Quality rules whose cutoffs are quantiles of each language and source, from mergeable sketches.

Built-in functions only: the text never leaves the JVM. Every document gives a few counts, written once as a
narrow table. A sketch is a table of counts per bucket of a log-linear scale (exact below ``EXACT``, then 32
buckets for each doubling), so two sketches merge by adding counts, in any order and on any machine, and the
same rows always give the same quantiles. A document fails where a measure lies beyond a far fence of its group:
the upper quartile plus ``SPREADS`` times the distance of the quartiles, likewise below the lower quartile.

Sketches hold documents that pass the base rules. A group with fewer than ``LEAST_DOCS`` of them takes the
quartiles of its language (its sources' sketches merged), a language with fewer those of all documents.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import materialise

#: Words are runs of anything but these blanks; symbols are counted one by one.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Base rules: fewest words, highest share of repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents a group needs for quartiles of its own, width of the fences in quartile distances.
LEAST_DOCS, SPREADS = 200, 3
#: Values below it have a bucket each.
EXACT = 64


class Measure(NamedTuple):
    """One measured share: ``part`` for each ``scale`` of ``whole``, and the least quartile distance its fences take."""

    name: str
    part: str
    whole: str
    scale: int
    least_spread: int
    below: bool = False


#: Quartiles of clean groups often coincide at 0, so a least distance keeps documents with a few hits.
MEASURES = (
    Measure("word_length", "word_chars", "n_words", 1000, 500, below=True),
    Measure("symbols", "n_symbols", "n_words", 10_000, 300),
    Measure("repeated_lines", "n_dup_lines", "n_lines", 10_000, 1500),
    Measure("repeated_words", "n_repeat_words", "n_words", 10_000, 1500),
)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that stand twice or more in the array ``words``, first ones included.

    Windows are sorted within their row by a hash and then their words, so equal ones are neighbours.
    """
    last = F.lit(2**30)  # start plus length must stay an int
    rows = F.arrays_zip(words.alias("a"), F.slice(words, 2, last).alias("b"), F.slice(words, 3, last).alias("c"))
    windows = F.slice(rows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def keyed(window: Column, place: Column) -> Column:
        a, b, c = (window.getField(k) for k in "abc")
        return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), place.alias("i"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def places(ordered: Column) -> Column:
        twice = F.transform(
            ordered,
            lambda w, k: F.when(same(w, F.get(ordered, k - 1)) | same(w, F.get(ordered, k + 1)), w["i"]),
        )
        return F.transform(F.filter(twice, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2))

    return F.size(F.array_distinct(F.flatten(_bound(F.sort_array(F.transform(windows, keyed)), places))))


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts of the whole text, base_failed), one row per row of ``docs``.

    A null text counts as no text; a null lang or source is the group ''. Other columns are left out.
    """
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")],
    ).select(
        "doc_id", "lang", "source", "text",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )

    def without(characters: str) -> Column:
        return F.length(F.translate("text", characters, ""))

    measured = split.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        without(BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def measure(m: Measure) -> Column:
    return F.expr(f"{m.scale} * {m.part} div greatest({m.whole}, 1)")


def bucket(value: Column) -> Column:
    """Lowest value of the bucket of a whole number that is not negative."""
    bits = F.length(F.bin(value)) - 6
    return F.when(value < EXACT, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over the rows of :func:`counts` that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(m.name).alias("measure"), bucket(measure(m)).alias("bucket")) for m in MEASURES])
    rows = counted.filter(~F.col("base_failed")).select("lang", "source", F.inline(pairs))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets are added."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, docs, and a map from each measure to its quartiles); a window sees the buckets of one sketch, 2 000 at most."""
    scale = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(scale.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(scale)
    ranked = sketch.select(*keys, "measure", "bucket", "n", upto.alias("upto"), total.alias("total"))

    def at(quarters: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= quarters * F.col("total"), F.col("bucket")))

    ends = ranked.groupBy(*keys, "measure").agg(at(1).alias("low"), at(3).alias("high"), F.max("total").alias("docs"))
    entry = F.struct("measure", F.struct("low", "high"))
    return ends.groupBy(*keys).agg(F.max("docs").alias("docs"), F.map_from_entries(F.collect_list(entry)).alias("ends"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, and for each measure the least and greatest value that is kept), one row per group with a sketch."""
    own = quartiles(sketch, "lang", "source")
    by_language = quartiles(merged(sketch, "lang"), "lang").select("lang", F.col("docs").alias("lang_docs"), F.col("ends").alias("lang_ends"))
    overall = quartiles(merged(sketch)).select(F.col("ends").alias("all_ends"))
    groups = own.join(by_language, "lang").join(F.broadcast(overall))  # one row
    ends = (
        F.when(F.col("docs") >= LEAST_DOCS, F.col("ends"))
        .when(F.col("lang_docs") >= LEAST_DOCS, F.col("lang_ends"))
        .otherwise(F.col("all_ends"))
    )
    columns = []
    for m in MEASURES:
        low, high = ends[m.name]["low"], ends[m.name]["high"]
        spread = SPREADS * F.greatest(high - low, F.lit(m.least_spread))
        columns += [
            (low - spread if m.below else F.lit(0)).cast("long").alias(f"least_{m.name}"),
            (high + spread).alias(f"most_{m.name}"),
        ]
    return groups.select("lang", "source", *columns)


def rated(docs: DataFrame) -> DataFrame:
    """Counts of :func:`counts`, ``base_failed`` and ``kept``, one row per row of ``docs`` (repeated rows too).

    Ties: a value on a fence is kept. Empty and null texts have counts of 0 and fail the base rules. Counts and
    fences are tables in the shared folder, so texts are read once and Spark joins fences by their known size.
    """
    counted = materialise(counts(docs), "quality-counts")
    limits = materialise(fences(sketches(counted)), "quality-fences")
    inside = ~F.col("base_failed")
    for m in MEASURES:
        inside &= measure(m).between(F.col(f"least_{m.name}"), F.col(f"most_{m.name}"))
    return counted.join(limits, ["lang", "source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(inside, F.lit(False)).alias("kept"), "lang", "source", "n_lines",
    )


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id the rules keep, with all their columns; a repeated doc_id needs one kept row, null goes."""
    keep = rated(docs).filter("kept").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"] == keep["doc_id"], "left_semi")
