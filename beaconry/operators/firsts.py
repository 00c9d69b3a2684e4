"""First or last row per key as partial aggregations.

``min``/``max`` over a struct combine on the map side, so a key that holds a
large share of all rows reaches the reducer as one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    value = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[F.col(c) for c in order])
    out = df.groupBy(*keys).agg(pick(value, rank).alias("_row"))
    return out.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` of each key; ``order`` must be unique per key."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def first_match(df: DataFrame, condition: Column, order: Sequence[str], **defaults) -> DataFrame:
    """The first row that satisfies ``condition``, else one row of ``defaults``.

    A default that names no value falls back to the first row of the whole table.
    """
    order_columns = [F.col(c) for c in order]
    ranked = df.withColumn("_miss", F.when(condition, 0).otherwise(1))
    if not defaults:
        return ranked.orderBy("_miss", *order_columns).limit(1).drop("_miss")
    hit = df.filter(condition).orderBy(*order_columns).limit(1)
    row = hit.agg(*[F.first(c).alias(c) for c in df.columns])
    return row.select(
        *[F.coalesce(c, F.lit(defaults.get(c))).alias(c) for c in df.columns]
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key.

    The rank filter lets Spark keep only ``k`` rows per key in every map task
    (WindowGroupLimit) before the shuffle, so hot keys stay small.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
