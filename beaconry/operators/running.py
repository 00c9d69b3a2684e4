"""Running counts and sums that stay distributed when one key is hot.

A plain window puts a whole key into one task.  Here the ordered rows of a key
are cut into chunks by an expression that grows with the order; windows run per
(key, chunk), chunk totals are prefixed in a second, small window, and the two
are joined.  Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_prefix(totals: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums of per-chunk totals (one small row per key and chunk)."""
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names],
    )


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Mapping[str, Column],
    at_most: float | None = None,
) -> DataFrame:
    """Add, per name in ``values``, the sum over all earlier rows of the same key.

    ``chunk`` must not decrease along ``order``.  With ``at_most``, rows whose sum is
    larger are dropped; chunks that lie behind it as a whole go before any sorting.
    """
    chunked = df.withColumns({"_chunk": chunk, **{f"_v_{n}": c for n, c in values.items()}})
    totals = chunked.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(n) for n in values]
    )
    prefix = chunk_prefix(totals, keys, list(values))
    if at_most is not None:
        prefix = prefix.filter(within([F.col(f"_before_{n}") for n in values], at_most))
    earlier = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = chunked.join(prefix, [*keys, "_chunk"])
    local = joined.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)) for n in values}
    )
    out = local.select(
        *df.columns, *[(F.col(f"_before_{n}") + F.col(f"_l_{n}")).alias(n) for n in values]
    )
    return out if at_most is None else out.filter(within([F.col(n) for n in values], at_most))


def within(columns: Sequence[Column], limit: float) -> Column:
    return reduce(lambda a, b: a & b, [c <= limit for c in columns])


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "ordinal"
) -> DataFrame:
    """1-based position of each row within its key."""
    numbered = running_before(df, keys, order, chunk, {name: F.lit(1).cast("bigint")})
    return numbered.withColumn(name, F.col(name) + 1)


def pace_requests(
    requests: DataFrame,
    key: str,
    micros: str,
    row_id: str,
    interval_us: int,
    chunk_us: int = 3_600_000_000,
) -> DataFrame:
    """Earliest allowed start of each request: ``max(arrival, previous start + interval)``.

    With ``i`` the position of a request, ``start = i*d + max(t_j - j*d)`` over all
    requests up to it.  Both the position and the maximum split into a part inside
    the chunk and a prefix over earlier chunks.
    """
    d = F.lit(interval_us)
    inside = Window.partitionBy(key, "_chunk").orderBy(micros, row_id)
    local = requests.withColumn("_chunk", F.floor(F.col(micros) / chunk_us)).withColumn(
        "_j", F.row_number().over(inside).cast("bigint")
    )
    local = local.withColumn("_slack", F.col(micros) - F.col("_j") * d)
    totals = local.groupBy(key, "_chunk").agg(
        F.count("*").alias("n"), F.max("_slack").alias("_peak")
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.withColumn(
        "_earlier", F.max(F.col("_peak") - F.col("_offset") * d).over(before)
    ).select(key, "_chunk", "_offset", "_earlier")
    running = local.withColumn(
        "_own", F.max("_slack").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = running.join(offsets, [key, "_chunk"])
    highest = F.greatest("_earlier", F.col("_own") - F.col("_offset") * d)
    start = (F.col("_offset") + F.col("_j")) * d + highest
    return joined.select(
        *requests.columns, start.alias("start_us"), (start > F.col(micros)).alias("delayed")
    )


def pacing_interval_us(requests_per_minute: int) -> int:
    return 60_000_000 // requests_per_minute


#: Rows of the last cell of a cut that one task may sort.
CUT_ROWS = 10_000


def cumulative_cut(
    df: DataFrame,
    size: str,
    levels: Sequence[Column],
    order: Sequence[str],
    need: float,
    most_rows: int = CUT_ROWS,
) -> DataFrame:
    """Rows, in ``order``, while the total size of all earlier rows is below ``need``.

    The cut is found like a radix select: sizes are summed per cell of the first
    level, the one cell the cut falls into is refined by the next level until it has
    ``most_rows`` rows at most, and only those are sorted.  No step orders the whole table,
    also where all rows share the first levels.  Each level must not decrease along ``order``
    inside the cell before it and must have a bounded number of values; the last levels should
    tell all rows apart.  More rows than ``most_rows`` that no level parts are taken together.
    """
    cell, before, rows = F.lit(True), 0, None
    taken = F.lit(False)
    for level in levels:
        sums = df.filter(cell).groupBy(level.alias("_cell")).agg(
            F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_rows")
        )
        earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        edge = (
            sums.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)) + before)
            .filter((F.col("_before") < need) & (F.col("_before") + F.col("_size") >= need))
            .orderBy("_cell")
            .limit(1)
            .collect()
        )
        if not edge:
            return df.filter(taken | (cell & F.lit(need > before)))
        before, rows = edge[0]["_before"], edge[0]["_rows"]
        taken = taken | (cell & (level < F.lit(edge[0]["_cell"])))
        cell = cell & (level == F.lit(edge[0]["_cell"]))
        if rows <= most_rows:
            break
    if rows is not None and rows > most_rows:
        return df.filter(taken | cell)
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        df.filter(cell)
        .withColumn("_before", F.coalesce(F.sum(size).over(earlier), F.lit(0)) + before)
        .filter(F.col("_before") < need)
    )
    return df.filter(taken).unionByName(inside.drop("_before"))
