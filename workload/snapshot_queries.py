"""TTL cache, pacing and change detection over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions.keys import cache_key, expires_at, text_hash
from beaconry.operators import running, snapshot_store, snapshots
from beaconry.operators.replay import cache_hits
from beaconry.session import scratch_path
from workload.registry import query, table

SQL_AS_OF = "TIMESTAMP '1997-01-01'"
HOUR_US = 3_600_000_000
TTL_US = 24 * HOUR_US


def as_of():
    return F.expr("timestamp_ntz'1997-01-01 00:00:00'")


def _orders(spark, sf):
    """Orders as snapshot rows: the order date is the creation time."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("identifier"),
        F.col("o_orderstatus").alias("payload"),
        F.col("o_orderdate").alias("created_at"),
        expires_at(F.col("o_orderdate")).alias("expires_at"),
        text_hash(F.col("o_orderstatus")).alias("content_hash"),
        F.col("o_totalprice").cast("bigint").alias("size_bytes"),
    )


def _page_snapshot(spark, sf):
    """Pages as snapshot rows; groups of forty page ids expire at the same hour."""
    pages = table(spark, sf, "pages")
    hours = F.make_dt_interval(hours=F.floor(F.col("page_id") / 40).cast("int"))
    return pages.select(
        "page_id",
        F.col("url").alias("identifier"),
        cache_key(F.col("url")).alias("key"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + hours).alias("expires_at"),
        F.length("html").cast("bigint").alias("size_bytes"),
    )


def _requests(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id", "user_id", "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
    )


def _user_events(spark, sf):
    """Events as snapshot rows: the newest of a user counts."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("identifier"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("content_hash"),
        "event_type",
    )


@query(
    "snapshot_upsert",
    """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
    """,
)
def snapshot_upsert(spark, sf):
    """Events as upserts per user: purchases come first and make the stored table, the rest arrive later."""
    rows = _user_events(spark, sf)
    stored, fresh = rows.filter("event_type = 'purchase'"), rows.filter("event_type != 'purchase'")
    stored = snapshots.upsert(stored.filter(F.lit(False)), stored)
    return snapshots.upsert(stored, fresh).select(
        F.col("identifier").alias("user_id"), F.col("content_hash").alias("event_id"), "event_type"
    )


SQL_NEWEST = """
    SELECT user_id, event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
"""


@query("snapshot_commits", SQL_NEWEST)
def snapshot_commits(spark, sf):
    """The same upserts as commits to a snapshot in buckets: purchases, then the other kinds one after the other."""
    rows = _user_events(spark, sf)
    path, buckets = scratch_path(spark, "snapshot"), 16
    stored = rows.filter("event_type = 'purchase'")
    snapshot_store.create(snapshots.upsert(stored.filter(F.lit(False)), stored), path, buckets)
    late = rows.filter("event_type != 'purchase'")
    for half in (0, 1):
        part = late.filter(F.pmod(F.xxhash64("content_hash"), F.lit(2)) == half)
        snapshot_store.commit_upsert(path, part, buckets, f"late-{half}")
    return snapshot_store.read(spark, path, rows.schema).select(
        F.col("identifier").alias("user_id"), F.col("content_hash").alias("event_id"), "event_type"
    )


@query(
    "snapshot_read",
    f"SELECT o_orderkey AS identifier FROM orders WHERE o_orderdate + INTERVAL 90 DAY >= {SQL_AS_OF}",
)
def snapshot_read(spark, sf):
    return snapshots.read_valid(_orders(spark, sf), as_of()).select("identifier")


@query(
    "snapshot_expire",
    f"SELECT count(*) AS expired FROM orders WHERE o_orderdate + INTERVAL 90 DAY < {SQL_AS_OF}",
)
def snapshot_expire(spark, sf):
    return snapshots.expire(_orders(spark, sf), as_of())[1]


@query(
    "snapshot_delete",
    "SELECT o_orderkey AS identifier FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def snapshot_delete(spark, sf):
    gone = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("identifier")
    )
    return snapshots.delete(_orders(spark, sf), gone).select("identifier")


@query(
    "snapshot_stats",
    "SELECT count(*) AS entry_count, round(sum(length(html)) / 1048576.0, 2) AS total_mb, cast(500 AS DOUBLE) AS max_mb FROM pages",
)
def snapshot_stats(spark, sf):
    return snapshots.stats(_page_snapshot(spark, sf))


@query(
    "snapshot_evict",
    """
    WITH s AS (SELECT page_id, length(html) AS size, row_number() OVER (ORDER BY floor(page_id / 40), left(sha256(url), 32)) AS n FROM pages),
    r AS (SELECT page_id, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT page_id FROM r WHERE total > 500000 AND total - before > 0.8 * 500000
    """,
)
def snapshot_evict(spark, sf):
    return snapshots.evicted(_page_snapshot(spark, sf), 500_000).select("page_id")


@query(
    "snapshot_evict_one_time",
    """
    WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS id, cast(l_quantity AS BIGINT) AS size, left(sha256(cast(l_orderkey * 8 + l_linenumber AS VARCHAR)), 32) AS key FROM lineitem),
    r AS (SELECT id, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY key, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT id FROM r WHERE total > 50000 AND total - before > 0.8 * 50000
    """,
)
def snapshot_evict_one_time(spark, sf):
    """Order lines that all expire at the same time: the cut lies inside one time and is found by parts of the keys."""
    identifier = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(
        identifier.alias("id"), cache_key(identifier.cast("string")).alias("key"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("expires_at"), F.col("l_quantity").cast("bigint").alias("size_bytes"),
    )
    return snapshots.evicted(lines, 50_000).select("id")


@query(
    "expiry_of",
    """
    SELECT l_orderkey AS identifier, strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') AS expires
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey
    """,
)
def expiry_of(spark, sf):
    asked = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("identifier"))
    found = snapshots.expiry_of(_orders(spark, sf), asked)
    return found.select("identifier", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@query(
    "content_changes",
    """
    WITH fresh AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS s FROM lineitem GROUP BY 1)
    SELECT coalesce(o_orderkey, l_orderkey) AS identifier, CASE WHEN o_orderkey IS NULL THEN 'new' WHEN l_orderkey IS NULL THEN 'gone'
        WHEN o_orderstatus = s THEN 'same' ELSE 'changed' END AS status FROM orders FULL JOIN fresh ON o_orderkey = l_orderkey
    """,
)
def content_changes(spark, sf):
    """Stored order status against the status its line items imply now."""
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    fresh = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("identifier")).agg(
        text_hash(F.when(low == high, low).otherwise("P")).alias("content_hash")
    )
    return snapshots.content_changes(_orders(spark, sf), fresh).select("identifier", "status")


@query(
    "pace_requests",
    """
    SELECT event_id, i * 7200000000 + max(t - i * 7200000000) OVER (PARTITION BY user_id ORDER BY t, event_id) AS start_us,
        i * 7200000000 + max(t - i * 7200000000) OVER (PARTITION BY user_id ORDER BY t, event_id) > t AS delayed
    FROM (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    """,
)
def pace_requests(spark, sf):
    paced = running.pace_requests(
        _requests(spark, sf), "user_id", "t", "event_id", 2 * HOUR_US
    )
    return paced.select("event_id", "start_us", "delayed")


@query(
    "cache_hits",
    f"""
    WITH RECURSIVE r AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
    m AS (SELECT user_id, event_type, min(t) AS t FROM r GROUP BY 1, 2
        UNION ALL SELECT m.user_id, m.event_type, n.t FROM m, LATERAL (SELECT min(r.t) AS t FROM r
            WHERE r.user_id = m.user_id AND r.event_type = m.event_type AND r.t > m.t + {TTL_US}) n WHERE n.t IS NOT NULL),
    f AS (SELECT user_id, event_type, t, min(event_id) AS event_id FROM r JOIN m USING (user_id, event_type, t) GROUP BY 1, 2, 3)
    SELECT r.event_id, f.event_id IS NOT NULL AS miss FROM r LEFT JOIN f ON f.event_id = r.event_id
    """,
)
def cache_hits_replay(spark, sf):
    keys = ["user_id", "event_type"]
    return cache_hits(_requests(spark, sf), keys, "t", "event_id", TTL_US).select("event_id", "miss")
