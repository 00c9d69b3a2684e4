"""Page ingest and request replay on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, IntegralType, StringType, StructField, StructType

from beaconry.functions import fixed_values as fixed
from beaconry.operators.firsts import last_per_key
from beaconry.operators.replay import misses_in_order
from beaconry.operators.snapshots import snapshot_rows
from beaconry.plans.sheets import Rules, parse_sheets
from beaconry.session import persist_clustered
from beaconry.sources.html_elements import element_table
from beaconry.sources.pages import normalise_pages, successful


def page_elements(pages: DataFrame) -> DataFrame:
    """Elements of freshly fetched pages, clustered by page."""
    return element_table(successful(normalise_pages(pages)), cluster=True)


def page_entries(
    pages: DataFrame, created_at: str, rules: Rules = Rules(), elements: DataFrame | None = None
) -> DataFrame:
    """Snapshot rows of freshly fetched pages: the whole parsed sheet as JSON per URL.

    An entry was made when its page was fetched (``scraped_at``, seconds), else at ``created_at``.
    Give cached ``elements`` of :func:`page_elements`, or every branch of the sheet parses the pages.
    """
    good = successful(normalise_pages(pages))
    fetched = F.coalesce(F.timestamp_seconds("scraped_at"), F.lit(created_at).cast("timestamp"))
    elements = page_elements(pages) if elements is None else elements
    sheets = parse_sheets(elements, good, rules=rules)
    fields = [c for c in sheets.columns if c not in ("page_id", "url")]
    entries = sheets.join(good.select("page_id", fetched.alias("created_at")), "page_id").select(
        F.col("url").alias("identifier"),
        F.to_json(F.struct(*fields)).alias("payload"),
        "created_at",
    )
    return snapshot_rows(entries)


def newest_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch the newest version per URL, by the order of :class:`NewestVersion`.

    Versions that stand near each other need not be shuffled with their contents then.
    """
    order = [(name, "ascending") for name in ("url", "fetched", "content_hash", "page_id")]
    for batch in batches:
        rank = pc.sort_indices(batch.select([name for name, _ in order]), sort_keys=order, null_placement="at_start")
        urls = pc.dictionary_encode(batch.column("url").take(rank), null_encoding="encode").indices.to_numpy()
        newest = np.append(urls[1:] != urls[:-1], True)[: len(urls)]
        yield batch.take(rank.filter(pa.array(newest)))


class NewestVersion(StatefulProcessor):
    """Per URL: time and content hash of its newest version; gives out rows whose content is new.

    A version counts as newer if it was fetched later or, at the same time, came later; of one
    micro-batch the larger hash does. Older versions and unchanged contents give nothing.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "fetched bigint, content_hash string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r.fetched, r.content_hash, r.page_id is not None, r.page_id))
        known = self.newest.get() if self.newest.exists() else None
        if known is not None and best.fetched < known[0]:
            return
        self.newest.update((best.fetched, best.content_hash))
        if known is None or best.content_hash != known[1]:
            yield best

    def close(self) -> None:
        pass


def changed_pages(pages: DataFrame, created_at: str, ttl_days: int = fixed.PAGE_TTL_DAYS) -> DataFrame:
    """Versions of a stream of pages whose URL is new or whose content changed, by keyed state.

    The state of a URL is one time and one hash and is dropped ``ttl_days`` after its last
    version, when its snapshot entry is expired too. Start the query by :func:`start_stateful`.
    """
    good = successful(normalise_pages(pages))
    fetched = F.coalesce(F.timestamp_seconds("scraped_at"), F.lit(created_at).cast("timestamp"))
    content = F.sha2(F.to_json(F.struct("html", "markdown")), 256)
    rows = good.withColumns({"fetched": F.unix_micros(fetched), "content_hash": content})
    state = NewestVersion(ttl_days * 86_400_000)
    rows = rows.mapInArrow(newest_versions, rows.schema)
    return rows.groupBy("url").transformWithState(state, rows.schema, "Append", "ProcessingTime").drop(
        "fetched", "content_hash"
    )


def start_stateful(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query with keyed state that ends when the data does; its settings are the query's own."""
    conf = stream.sparkSession.conf
    settings = {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # State with a life time asks for a batch without data again and again.
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        return (
            stream.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def ingest_pages(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    created_at: str,
    rules: Rules = Rules(),
    ttl_days: int = fixed.PAGE_TTL_DAYS,
) -> StreamingQuery:
    """Parse the pages of every micro-batch that are new or changed and store their snapshot rows.

    Each batch goes to its own folder, overwritten when the batch is retried, so a
    restart neither loses nor repeats rows.  :func:`ingested` merges the batches.

    Every reading of a batch works through the keyed state again, and stages that do so at the same
    time wait for each other's state store until that is an error.  So a batch is read once, into
    ``{target}-changed``, which holds the pages of one batch and is overwritten by the next.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        changed = f"{target}-changed"
        batch.write.mode("overwrite").option("compression", "zstd").parquet(changed)
        pages = batch.sparkSession.read.schema(batch.schema).parquet(changed)
        elements = persist_clustered(page_elements(pages))
        try:
            elements.count()  # joins are planned by the size of what is cached
            entries = page_entries(pages, created_at, rules, elements)
            entries.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        finally:
            elements.unpersist()

    return start_stateful(changed_pages(stream, created_at, ttl_days), store, checkpoint)


def ingested(spark, target: str) -> DataFrame:
    """Newest row per identifier: by time of fetching, then by batch."""
    rows = spark.read.parquet(target).withColumn("batch", F.col("batch").cast("bigint"))
    return last_per_key(rows, ["identifier"], ["created_at", "batch", "content_hash"]).drop("batch")


def stream_cache_hits(
    requests: DataFrame,
    keys: Sequence[str],
    time: str,
    row_id: str,
    ttl_us: int,
    lateness: str = "1 hour",
    buckets: int = 2_048,
) -> DataFrame:
    """Hit or miss per request of a stream; the state of a key is one expiry time.

    Keys are dealt into ``buckets`` by hash, and each bucket keeps the expiry times of its keys, so a
    micro-batch costs a Python call per bucket, not per key.  Rows of a micro-batch are put in time
    order per bucket, so size micro-batches (for files ``maxFilesPerTrigger``) and buckets to
    what one task can sort.  Rows later than the watermark are dropped by Spark; what a
    key has is dropped in a later call of its bucket, or when the whole bucket times out, which
    cannot change a result because it is expired by then.
    """
    fields = requests.select(*keys, time, row_id).schema
    # Whole numbers with nulls would become floats in pandas.
    whole = [k for k in keys if isinstance(fields[k].dataType, IntegralType)]
    carried = fields.fields[: len(keys)]
    schema = StructType([StructField(f.name, StringType()) if f.name in whole else f for f in carried])
    schema = schema.add(fields[time]).add(fields[row_id]).add("_no_id", "boolean").add("miss", "boolean")

    def replay(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        micros = rows[time].to_numpy().astype("datetime64[us]").astype("int64")
        owner, owners = pd.factorize(rows["_owner"])
        order = np.lexsort((rows[row_id].to_numpy(), rows["_no_id"].to_numpy(), micros, owner))
        micros, ends = micros[order], np.cumsum(np.bincount(owner, minlength=len(owners)))
        expiries = dict(zip(*state.get)) if state.exists else {}
        flags = np.zeros(len(rows), dtype=bool)
        fresh, start = {}, 0
        for name, end in zip(owners, ends.tolist()):
            found, expiry = misses_in_order(micros[start:end], expiries.pop(name, None), ttl_us)
            flags[order[start:end][found]] = True
            fresh[name], start = int(expiry), end
        watermark = state.getCurrentWatermarkMs()
        fresh.update((name, expiry) for name, expiry in expiries.items() if expiry // 1000 + 1 > watermark)
        state.update((list(fresh), list(fresh.values())))
        state.setTimeoutTimestamp(max(max(fresh.values()) // 1000 + 1, watermark + 1))
        yield rows.drop(columns=["_owner", "_bucket"]).assign(miss=flags)

    named = F.to_json(F.struct(*[(F.hex(k) if isinstance(fields[k].dataType, BinaryType) else F.col(k).cast("string")).alias(k) for k in keys]))
    known_id = F.coalesce(row_id, F.lit(0)) if isinstance(fields[row_id].dataType, IntegralType) else F.col(row_id)
    replayed = (
        requests.select(
            *[F.col(k).cast("string").alias(k) if k in whole else F.col(k) for k in keys],
            time,
            known_id.cast(fields[row_id].dataType).alias(row_id),
            F.col(row_id).isNull().alias("_no_id"),
            named.alias("_owner"),
            F.pmod(F.xxhash64(named), F.lit(buckets)).alias("_bucket"),
        )
        .withWatermark(time, lateness)
        .groupBy("_bucket")
        .applyInPandasWithState(
            replay, schema, "owners array<string>, expiries array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return replayed.select(
        *[F.col(k).cast(fields[k].dataType) for k in keys],
        time,
        F.when(~F.col("_no_id"), F.col(row_id)).alias(row_id),
        "miss",
    )
