"""Snapshots kept in hash buckets, of which an upsert rewrites only those it touches.

``path/data/version=<n>/bucket=<b>`` holds the rows that commit ``n`` wrote for a bucket, and
each file below ``path/manifests`` names, for every bucket, the version that counts after one
commit. A manifest is a single small file that appears at once or not at all, so readers
see whole commits; data without a manifest is overwritten by the next attempt at its version.
A commit that is asked for again under the same ``batch`` name changes nothing. One writer at
a time; readers may ask for any version, as the folders of older ones stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.operators.snapshots import upsert

MANIFEST = "version bigint, batch string, bucket int, wrote bigint"


def bucket_of(identifier: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(identifier.cast("string")), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifests")


def _state(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int], set[str]]:
    """Version, the version that wrote each bucket, and the batches so far; as many rows as buckets."""
    commits = _manifests(spark, path).select("version", "batch").distinct().collect()
    done = [c for c in commits if version is None or c.version <= version]
    if not done:
        raise ValueError(f"no snapshot version {version or ''} below {path}")
    last = max(c.version for c in done)
    rows = _manifests(spark, path).filter(F.col("version") == last).collect()
    return last, {r.bucket: r.wrote for r in rows if r.bucket >= 0}, {c.batch for c in done}


def _commit(spark: SparkSession, path: str, version: int, batch: str, wrote: dict[int, int]) -> None:
    # Bucket -1 keeps the manifest of an empty snapshot from being an empty file.
    rows = [(version, batch, b, v) for b, v in sorted({-1: version, **wrote}.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")


def _folder(path: str, version: int) -> str:
    return f"{path}/data/version={version}"


def _write(rows: DataFrame, path: str, version: int, buckets: int) -> set[int]:
    """Write the rows of the touched buckets, a task per bucket, and tell which buckets have rows now."""
    placed = rows.withColumn("bucket", bucket_of(F.col("identifier"), buckets)).repartition("bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(_folder(path, version))
    spark = rows.sparkSession
    written = spark.read.schema(placed.schema).option("basePath", _folder(path, version)).parquet(_folder(path, version))
    return {r.bucket for r in written.select("bucket").distinct().collect()}


def _read(spark: SparkSession, path: str, schema, wrote: dict[int, int]) -> DataFrame:
    folders = [f"{_folder(path, v)}/bucket={b}" for b, v in sorted(wrote.items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def create(snapshot: DataFrame, path: str, buckets: int, batch: str = "create") -> None:
    """First commit: ``snapshot`` has one row per identifier; a bucket should fit a task."""
    written = _write(snapshot, path, 0, buckets)
    _commit(snapshot.sparkSession, path, 0, batch, {b: 0 for b in written})


def commit_upsert(path: str, entries: DataFrame, buckets: int, batch: str) -> int:
    """Newest entry per identifier, as :func:`beaconry.operators.snapshots.upsert` decides; gives the version.

    Only buckets of ``entries`` are read and written again. ``buckets`` is the number the snapshot
    was created with, ``batch`` a name that a retry of the same entries repeats.
    """
    spark = entries.sparkSession
    version, wrote, batches = _state(spark, path)
    if batch in batches:
        return version
    touched = {r.b for r in entries.select(bucket_of(F.col("identifier"), buckets).alias("b")).distinct().collect()}
    if not touched:
        _commit(spark, path, version + 1, batch, wrote)
        return version + 1
    stored = _read(spark, path, entries.schema, {b: v for b, v in wrote.items() if b in touched})
    written = _write(upsert(stored, entries), path, version + 1, buckets)
    kept = {b: v for b, v in wrote.items() if b not in touched}
    _commit(spark, path, version + 1, batch, kept | {b: version + 1 for b in written})
    return version + 1


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """Rows of the newest version, or of an older one."""
    return _read(spark, path, schema, _state(spark, path, version)[1])


def buckets_written(spark: SparkSession, path: str) -> DataFrame:
    """``(version, batch, rewritten, kept)``: buckets that each commit wrote and left alone."""
    rows = _manifests(spark, path).groupBy("version", "batch").agg(
        F.count_if((F.col("bucket") >= 0) & (F.col("wrote") == F.col("version"))).alias("rewritten"),
        F.count_if((F.col("bucket") >= 0) & (F.col("wrote") < F.col("version"))).alias("kept"),
    )
    return rows.select("version", "batch", "rewritten", "kept")
