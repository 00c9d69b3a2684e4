"""TTL- and size-bounded snapshot tables.

A snapshot row is ``(identifier, key, payload, created_at, expires_at,
content_hash, size_bytes)``.  Nothing reads the clock: callers pass ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.keys import cache_key, expires_at, text_hash
from beaconry.operators.firsts import last_per_key
from beaconry.operators.running import cumulative_cut


def snapshot_rows(
    entries: DataFrame, days: int | None = None, is_index: bool = False
) -> DataFrame:
    """Snapshot rows for ``(identifier, payload, created_at)`` entries."""
    return entries.select(
        "identifier",
        cache_key(F.col("identifier")).alias("key"),
        "payload",
        "created_at",
        expires_at(F.col("created_at"), days, is_index).alias("expires_at"),
        text_hash(F.col("payload")).alias("content_hash"),
        F.octet_length("payload").cast("bigint").alias("size_bytes"),
    )


def upsert(snapshot: DataFrame, entries: DataFrame) -> DataFrame:
    """Newest entry per identifier; a fresh one replaces a stored one of the same time, and of
    equally new fresh ones the larger hash stays.

    ``snapshot`` has one row per identifier. Only the fresh entries are reduced; stored rows are kept or dropped by their key and time.
    """
    fresh = last_per_key(entries, ["identifier"], ["created_at", "content_hash"])
    times = fresh.select("identifier", F.col("created_at").alias("_fresh"))
    both = snapshot.join(times, "identifier", "left")
    older = F.col("_fresh").isNotNull() & F.coalesce(F.col("created_at") <= F.col("_fresh"), F.lit(True))
    kept = both.filter(~older).drop("_fresh")
    newer = kept.select("identifier").distinct()
    return kept.select(snapshot.columns).unionByName(fresh.join(newer, "identifier", "left_anti"))


def is_valid(as_of: Column) -> Column:
    """A row is expired only strictly after ``expires_at``."""
    return F.col("expires_at") >= as_of


def read_valid(
    snapshot: DataFrame, as_of: Column, ignore_expiry: bool = False, enabled: bool = True
) -> DataFrame:
    if not enabled:
        return snapshot.filter(F.lit(False))
    return snapshot if ignore_expiry else snapshot.filter(is_valid(as_of))


def expire(snapshot: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The kept rows and the number of dropped ones."""
    kept = snapshot.filter(is_valid(as_of))
    return kept, snapshot.agg(F.count_if(~is_valid(as_of)).alias("expired"))


#: Length of the keys of snapshot rows.
KEY_CHARS = 32


def evicted(
    snapshot: DataFrame,
    max_bytes: float = fixed.MAX_CACHE_BYTES,
    target: float = fixed.EVICTION_TARGET,
) -> DataFrame:
    """Rows to remove, soonest expiry first, until the rest fits ``target * max_bytes``.

    Nothing is removed while the total is within ``max_bytes``.
    """
    total = snapshot.agg(F.sum("size_bytes").alias("total")).first()["total"] or 0
    if total <= max_bytes:
        return snapshot.filter(F.lit(False))
    # Texts sort like the times they show and need no time zone when compared later.
    times = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS"]
    keys = [F.substring("key", 1, length) for length in range(4, KEY_CHARS + 1, 4)]
    levels = [*[F.date_format("expires_at", t) for t in times], *keys]
    order = ["expires_at", "key"]
    return cumulative_cut(snapshot, "size_bytes", levels, order, total - target * max_bytes)


def evict(snapshot: DataFrame, max_bytes: float, target: float = fixed.EVICTION_TARGET) -> DataFrame:
    return delete(snapshot, evicted(snapshot, max_bytes, target))


def delete(snapshot: DataFrame, identifiers: DataFrame) -> DataFrame:
    return snapshot.join(identifiers.select("identifier").distinct(), "identifier", "left_anti")


def clear(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(F.lit(False))


def stats(snapshot: DataFrame, max_bytes: int = fixed.MAX_CACHE_BYTES) -> DataFrame:
    return snapshot.agg(
        F.count("*").alias("entry_count"),
        F.round(F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576, 2).alias("total_mb"),
    ).withColumn("max_mb", F.lit(round(max_bytes / 1048576, 2)))


def expiry_of(snapshot: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Expiry of each asked identifier, null if it is not stored."""
    asked = identifiers.select("identifier").distinct()
    return asked.join(snapshot.select("identifier", "expires_at"), "identifier", "left")


def cache_lookup(
    requests: DataFrame, snapshot: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Split requested identifiers into stored rows (hits) and those to fetch (misses)."""
    valid = snapshot.filter(is_valid(as_of))
    asked = requests.select("identifier").distinct()
    return (
        valid.join(asked, "identifier", "left_semi"),
        asked.join(valid.select("identifier"), "identifier", "left_anti"),
    )


def content_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Status per identifier: new, gone, same or changed (by content hash)."""
    old = stored.select("identifier", F.col("content_hash").alias("old_hash"))
    new = fresh.select("identifier", F.col("content_hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "gone")
        .when(F.col("old_hash") == F.col("new_hash"), "same")
        .otherwise("changed")
    )
    return old.join(new, "identifier", "full_outer").withColumn("status", status)
