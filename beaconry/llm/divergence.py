"""How far the term shares of each language's sources lie apart, by count-level bitmaps.

A group (language, source) holds, for each block of 64 terms of its language and each count that occurs there, one
long: the bits of the terms with that count. For two groups, AND and the number of set bits of two such longs
give how many terms of the block have count a in one and b in the other; each such cell is multiplied by the
difference of the two shares, which depend on the counts alone. Terms that one or both groups lack follow as
complements. Blocks are dealt over the tasks, and the sources of a block in tiles of ``TILE``, so neither a language
that holds most rows nor one with many sources lands in one task; pairs of sources are summed after that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import materialise, slices

#: Documents of its language a term must stand in, terms listed per group.
LEAST_DOCS, LISTED = 30, 50
#: Shares are whole billionths, counts are smoothed by ``PRIOR``.
UNIT, PRIOR = 1_000_000_000, 5
#: Hash buckets in which terms are numbered, sources compared as one tile, cells of one AND at a time.
BUCKETS, TILE, CELLS = 4096, 64, 1 << 20
#: Terms a task holds before it gives out their counts.
HELD = 400_000
#: Letters and bytes beyond ASCII make terms, A-Z become a-z, the rest parts them.
_TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of (lang, source, text as UTF-8) rows: counts held per group, given out whenever ``HELD`` terms are held."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = {
                "lang": pa.array([lang] * len(terms), pa.string()),
                "source": pa.array([source] * len(terms), pa.string()),
                "term": pa.array(terms, pa.binary()),
                "n": pa.array(n.values(), pa.int64()),
                "docs": pa.array(map(docs.__getitem__, terms), pa.int64()),
            }
            yield from pa.table(columns).to_batches(max_chunksize=100_000)
        held.clear()

    for piece in slices(batches, text=2):
        for lang, source, text in zip(*(piece.column(c).to_pylist() for c in range(3))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_TERM_BYTES).split()
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from given()
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group; nulls are ''.

    Every row of ``docs`` is a document. Tasks add up what they see before the shuffle, so a hot group or term moves
    as one row per task.
    """
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    found = texts.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def kept_terms(counted: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, bucket, bit, block): terms in enough documents of their language, numbered within hash buckets."""
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    bucketed = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    number = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1
    return bucketed.select("lang", "term", "total", "bucket", number.alias("_no")).select(
        "lang", "term", "total", (F.col("_no") % 64).alias("bit"),
        F.expr(f"cast(_no div 64 AS long) * {BUCKETS} + bucket").alias("block"),
    )


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)) of SQL expressions, exact for every long.

    Without terms the divisor is 1; no such share reaches the result.
    """
    return F.expr(
        f"1 + cast({UNIT} AS decimal(10,0)) * (cast({count} AS decimal(20,0)) + {PRIOR})"
        f" div greatest(cast({total} AS decimal(20,0)) + {PRIOR} * cast({terms} AS decimal(16,0)), cast(1 AS decimal(1,0)))"
    )


def _pair_sums(block: pa.Table) -> list[tuple]:
    """(source number a, number b, value) over the terms of one block, for all sources of tile i and tile j."""
    i, j = (block.column(c)[0].as_py() for c in ("i", "j"))
    tiles = np.asarray(block.column("tile"))
    columns = {c: np.asarray(block.column(c)) for c in ("source_no", "bits", "p", "zero")}
    size = int(block.column("terms")[0].as_py())
    sides = []
    for tile in (i, j):
        rows = np.flatnonzero(tiles == tile)
        rows = rows[np.argsort(columns["source_no"][rows], kind="stable")]
        bits = columns["bits"][rows].view(np.uint64)
        sources, starts = np.unique(columns["source_no"][rows], return_index=True)
        ones = np.bitwise_count(bits).astype(np.int64)
        sides.append((sources, starts, bits, ones, columns["p"][rows], columns["zero"][rows][starts]))
    (sa, ka, ba, na, pa_, za), (sb, kb, bb, nb, pb, zb) = sides
    both = np.zeros((len(sa), len(sb)), np.int64)  # terms that both have
    value = np.zeros((len(sa), len(sb)), np.int64)
    rest_b = np.zeros((len(bb), len(sa)), np.int64)  # terms of a level of b that a source of a has
    step = max(1, CELLS // max(len(bb), 1))
    ends = np.append(ka[1:], len(ba))
    for k, (first, end) in enumerate(zip(ka, ends)):
        for x in range(first, end, step):
            rows = slice(x, min(x + step, end))
            cells = np.bitwise_count(ba[rows, None] & bb[None, :]).astype(np.int64)
            value[k] += np.add.reduceat((cells * np.abs(pa_[rows, None] - pb[None, :])).sum(0), kb)
            of_b = np.add.reduceat(cells, kb, axis=1)
            both[k] += of_b.sum(0)
            value[k] += ((na[rows, None] - of_b) * np.abs(pa_[rows, None] - zb[None, :])).sum(0)
            rest_b[:, k] += cells.sum(0)
    only_b = (nb[:, None] - rest_b) * np.abs(pb[:, None] - za[None, :])
    value += np.add.reduceat(only_b, kb, axis=0).T
    neither = size - np.add.reduceat(na, ka)[:, None] - np.add.reduceat(nb, kb)[None, :] + both
    value += neither * np.abs(za[:, None] - zb[None, :])
    return [(int(a), int(b), int(value[x, y])) for x, a in enumerate(sa) for y, b in enumerate(sb) if a < b]


def _tile_pairs(table: pa.Table) -> pa.Table:
    """Values of the pairs of sources of one (lang, block, i, j): 64 levels of 128 sources at most."""
    found = _pair_sums(table)
    columns = {name: pa.array([f[k] for f in found], pa.int64()) for k, name in enumerate(("a", "b", "value"))}
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(found), pa.string()), **columns})


def groups(docs: DataFrame, counted: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, source_no, kept, total, lang_total): every group, numbered in its language; its kept terms' occurrences."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = counted.join(terms.select("lang", "term"), ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = {"total": 0, "kept": 0, "lang_total": 0}
    return (
        every.withColumn("source_no", number.cast("long"))
        .join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(zero)
    )


def levels(counted: DataFrame, terms: DataFrame, group_table: DataFrame) -> DataFrame:
    """(lang, block, terms, source_no, tile, bits, p, zero): one row per count of a group in a block.

    Each group also has a row without bits in every block of its language, which carries the share of absent terms.
    """
    shares = group_table.withColumn("zero", share("0", "total", "kept"))
    blocks = terms.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("terms"))
    set_bits = (
        counted.filter("n > 0").join(terms.select("lang", "term", "block", "bit"), ["lang", "term"])
        .groupBy("lang", "source", "block", "n").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    tile = F.expr(f"cast(source_no div {TILE} AS int)").alias("tile")
    group_columns = ("lang", "source", "source_no", "total", "kept", "zero")
    present = set_bits.join(shares.select(*group_columns), ["lang", "source"]).join(blocks, ["lang", "block"]).select(
        "lang", "block", "terms", "source_no", tile, "bits", share("n", "total", "kept").alias("p"), "zero"
    )
    absent = blocks.join(shares.select(*group_columns), "lang").select(
        "lang", "block", "terms", "source_no", tile, F.lit(0).cast("long").alias("bits"), F.col("zero").alias("p"), "zero"
    )
    return present.unionByName(absent)


def pair_values(level_rows: DataFrame, group_table: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a < b, numbers of sources of one language; absent for languages without kept terms."""
    tiles = group_table.groupBy("lang").agg(F.expr(f"cast(max(source_no) div {TILE} AS int)").alias("last"))
    with_last = level_rows.join(tiles, "lang")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    dealt = with_last.select("*", other.alias("other")).withColumns(
        {"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}
    ).select("lang", "block", "i", "j", "terms", "source_no", "tile", "bits", "p", "zero")
    parts = dealt.groupBy("lang", "block", "i", "j").applyInArrow(_tile_pairs, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, listed: int = LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to every other source of its language
    (part ``pair``, all ranks) and the terms whose share most exceeds the language's (part ``term``, ``listed`` at most).

    Null text, lang and source are ''. Ties go to the smaller item in UTF-8. A language without kept terms has
    pairs of value 0; a group alone in its language has none. Repeated rows count as documents each. Counts are
    tables in the shared folder, so each text is split once and nothing is counted again after a loss.
    """
    counted = materialise(term_counts(docs), "term-counts")
    terms = materialise(kept_terms(counted, least_docs), "kept-terms")
    group_table = materialise(groups(docs, counted, terms), "term-groups")
    halves = materialise(pair_values(levels(counted, terms, group_table), group_table), "pair-values")
    names = group_table.select("lang", F.col("source_no").alias("a"), "source")
    others = group_table.select("lang", F.col("source_no").alias("b"), F.col("source").alias("item"))
    both = halves.union(halves.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = (
        names.join(others, "lang").filter("a != b")  # the pairs that the result lists
        .join(both, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    )
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    excess = (
        counted.filter("n > 0").join(terms.select("lang", "term", F.col("total").alias("in_lang")), ["lang", "term"])
        .join(group_table.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                (share("n", "total", "kept") - share("in_lang", "lang_total", "kept")).alias("value"))
        .filter("value > 0")
    )
    top = excess.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= listed)
    return pairs.withColumn("rank", F.row_number().over(place)).unionByName(top)
