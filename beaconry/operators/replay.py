"""Replay of a request log against a time-to-live rule.

A request is a hit until ``ttl`` after the last miss of its key (inclusive); the
next one is a miss and restarts the clock.  Each miss depends on the one before,
so keys are read in time order as a stream of Arrow batches whose only state is one
expiry: from a miss the next one is found by binary search, so the steps are the misses,
not the requests.  Where one key may own more of the log than a task should read,
the caller asks for ``split_keys``: every distinct time points to the time of the miss
that would follow it, and the chain from the first request is found by pointer
doubling over unique (key, time) pairs.  Both give the same rows.

A request without a time is no miss and leaves the clock alone; of requests at one time
the one with the smallest id comes first; null keys are keys like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.session import materialise

SUB_BUCKETS = 64


def cache_hits(
    requests: DataFrame,
    keys: Sequence[str],
    micros: str,
    row_id: str,
    ttl_us: int,
    split_keys: bool = False,
) -> DataFrame:
    """``requests`` (keys, time, id) with a boolean ``miss``."""
    rows = requests.select(*keys, micros, row_id)
    replay = chain_misses if split_keys else scan_misses
    return replay(rows, keys, micros, row_id, ttl_us)


def misses_in_order(times: np.ndarray, expiry: int | None, ttl_us: int) -> tuple[list[int], int | None]:
    """Places of the misses among rising times, and the expiry after them; ``expiry`` is that of the
    last miss before, None if there was none."""
    at = 0 if expiry is None else int(np.searchsorted(times, expiry, "right"))
    found = []
    while at < len(times):
        found.append(at)
        expiry = int(times[at]) + ttl_us
        at = int(np.searchsorted(times, expiry, "right"))
    return found, expiry


def scan_misses(
    rows: DataFrame, keys: Sequence[str], micros: str, row_id: str, ttl_us: int
) -> DataFrame:
    """One ordered pass per partition; the only state is the current key and its expiry."""
    schema = rows.select(*keys, micros, row_id).schema.add("miss", "boolean")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, expiry = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
            changed = np.any([np.diff(c) != 0 for c in codes], axis=0) if n > 1 else np.zeros(0, bool)
            starts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
            time = batch.column(micros)
            missing = np.asarray(time.is_null())
            values = time.fill_null(0).to_numpy(zero_copy_only=False)
            flags = np.zeros(n, dtype=bool)
            for a, b in zip(starts, starts[1:]):
                owner = tuple(batch.column(k)[a].as_py() for k in keys)
                if owner != current:
                    current, expiry = owner, None
                a += int(missing[a:b].sum())  # requests without a time are sorted first
                found, expiry = misses_in_order(values[a:b], expiry, ttl_us)
                flags[[a + at for at in found]] = True
            columns = [*batch.columns, pa.array(flags, type=pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "miss"])

    ordered = rows.select(*keys, micros, row_id).repartition(*keys)
    return ordered.sortWithinPartitions(*keys, micros, row_id).mapInArrow(scan, schema)


def chain_misses(
    rows: DataFrame, keys: Sequence[str], micros: str, row_id: str, ttl_us: int
) -> DataFrame:
    """The same result from pointer doubling; no task ever holds a whole key."""
    names = list(keys)
    # A struct compares its null fields as equal, so null keys join like others.
    rows = rows.withColumn("_key", F.struct(*names))
    keys = ["_key"]
    timed = rows.filter(F.col(micros).isNotNull())
    times = timed.select("_key", F.col(micros).alias("t")).distinct()
    times = materialise(times, "request-times")
    pointers = materialise(_next_miss(times, keys, ttl_us), "next-miss")
    reached = times.groupBy("_key").agg(F.min("t").alias("t"))
    span = times.groupBy("_key").agg((F.max("t") - F.min("t")).alias("s")).agg(F.max("s")).first()[0]
    rounds = math.ceil(math.log2((span or 0) // ttl_us + 2))
    for n in range(rounds):
        step = reached.join(pointers, ["_key", "t"]).select("_key", F.col("nxt").alias("t"))
        reached = materialise(reached.unionByName(step).distinct(), "reached")
        if n + 1 < rounds:
            onward = pointers.select("_key", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
            pointers = materialise(
                pointers.join(onward, ["_key", "nxt"]).select("_key", "t", F.col("far").alias("nxt")),
                "next-miss",
            )
    first = F.row_number().over(Window.partitionBy("_key", micros).orderBy(row_id)) == 1
    numbered = rows.withColumn("_first", first)
    misses = reached.withColumn("_reached", F.lit(True)).withColumnRenamed("t", micros)
    return numbered.join(misses, ["_key", micros], "left").select(
        *names, micros, row_id, (F.coalesce("_reached", F.lit(False)) & F.col("_first")).alias("miss")
    )


def _next_miss(times: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """``(t, nxt)``: the first time after ``t + ttl``; pairs without one are dropped.

    Looks inside the short time cell that holds ``t + ttl`` first, else takes the
    first time of the next cell that is not empty.
    """
    cell = F.floor(F.col("at") / (ttl_us / SUB_BUCKETS)).alias("cell")
    asks = times.select(*keys, (F.col("t") + ttl_us).alias("at"), F.col("t").alias("ask"))
    have = times.select(*keys, F.col("t").alias("at"), F.lit(None).cast("bigint").alias("ask"))
    both = asks.unionByName(have).withColumn("cell", cell)
    # Going down in time, an ask comes before a request at the same instant.
    later = (
        Window.partitionBy(*keys, "cell")
        .orderBy(F.desc("at"), F.col("ask").isNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = both.withColumn(
        "near", F.min(F.when(F.col("ask").isNull(), F.col("at"))).over(later)
    ).filter("ask is not null")
    cells = both.groupBy(*keys, "cell").agg(
        F.min(F.when(F.col("ask").isNull(), F.col("at"))).alias("first_at")
    )
    after = Window.partitionBy(*keys).orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    following = cells.withColumn("far", F.min("first_at").over(after)).drop("first_at")
    return (
        inside.join(following, [*keys, "cell"])
        .select(*keys, F.col("ask").alias("t"), F.coalesce("near", "far").alias("nxt"))
        .filter("nxt is not null")
    )
