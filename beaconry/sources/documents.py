"""JSON sheets, numbered-risk files, sitemaps, text files, reports and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.classify import category_of, normalize_severity
from beaconry.functions.keys import report_timestamp
from beaconry.functions.text import decode_lossy, slugify, slugify_ascii, strip
from beaconry.functions.urls import title_from_url
from beaconry.operators.firsts import last_per_key
from beaconry.session import materialise
from beaconry.sources import schemas

# Required sheet fields, and defaults of optional sheet and risk fields.
SHEET_REQUIRED = ["id", "title", "url"]
SHEET_DEFAULTS = {"description": "", "category": "General", "icon": "📋", "introduction": "",
                  "raw_markdown": ""}
RISK_DEFAULTS = {"icon": "⚠️", "description": ""}


def there_or_empty(read: Callable[[], DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    """``read()``, or ``empty()`` where its path does not exist."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty()


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def normalise_risk(risk: Column) -> Column:
    """Severity in canonical form, defaults filled, types as named pairs."""
    pairs = F.transform(
        F.coalesce(risk["types"], F.array().cast("array<array<string>>")),
        lambda t: F.struct(
            F.get(t, 0).alias("name"), F.coalesce(F.get(t, 1), F.lit("")).alias("descr")
        ),
    )
    return F.struct(
        risk["id"].alias("id"),
        F.coalesce(risk["title"], F.lit("")).alias("title"),
        normalize_severity(risk["severity"]).alias("severity"),
        *[F.coalesce(risk[k], F.lit(v)).alias(k) for k, v in RISK_DEFAULTS.items()],
        pairs.alias("types"),
        *[
            _strings(risk[k]).alias(k)
            for k in ("impacts", "mitigations", "examples", "references")
        ],
    )


def _read_json(
    spark: SparkSession, directory: str, schema: str, required: Sequence[str]
) -> DataFrame:
    """One row per file with its name; broken files keep ``_corrupt_record``."""
    full = f"{schema}, _corrupt_record string"
    rows = there_or_empty(
        lambda: spark.read.schema(full)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(directory)
        .withColumn("file_name", _file_name()),
        lambda: spark.createDataFrame([], f"{full}, file_name string"),
    )
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return rows.withColumn("_corrupt_record", F.coalesce("_corrupt_record", reason))


def read_sheet_json(spark: SparkSession, directory: str) -> DataFrame:
    """Sheets of a directory with their file names; bad files yield nothing, a missing directory is empty."""
    rows = _read_json(spark, directory, schemas.SHEET, SHEET_REQUIRED)
    good = rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return normalise_sheets(good)


def read_bad_sheets(spark: SparkSession, directory: str) -> DataFrame:
    """The files :func:`read_sheet_json` skipped, with the reason."""
    rows = _read_json(spark, directory, schemas.SHEET, SHEET_REQUIRED)
    return rows.filter(F.col("_corrupt_record").isNotNull()).select(
        "file_name", F.col("_corrupt_record").alias("reason")
    )


def normalise_sheets(sheets: DataFrame) -> DataFrame:
    columns = {k: F.coalesce(k, F.lit(v)) for k, v in SHEET_DEFAULTS.items()}
    columns["risks"] = F.coalesce(
        F.transform("risks", normalise_risk), F.array()
    )
    for name in ("contributors", "related_cheatsheets", "tags"):
        columns[name] = _strings(F.col(name))
    return sheets.withColumns(columns)


def read_numbered_risk_json(spark: SparkSession, directory: str) -> DataFrame:
    """One row per risk of every numbered-risk file; order by (file_name, risk_id) where it matters."""
    rows = _read_json(spark, directory, schemas.NUMBERED_RISKS, ["risks"])
    good = rows.filter(F.col("_corrupt_record").isNull())
    return normalise_risk_map(good)


def normalise_risk_map(sets: DataFrame) -> DataFrame:
    fixed_risks = F.transform_values("risks", lambda _, risk: normalise_risk(risk))
    exploded = sets.select(
        *[c for c in sets.columns if c not in ("risks", "_corrupt_record")],
        F.explode(fixed_risks).alias("risk_id", "risk"),
    )
    return exploded.select(
        F.col("id").alias("source_id"),
        *[c for c in exploded.columns if c not in ("id", "title", "risk", "risk_id")],
        "risk_id",
        *[F.col(f"risk.{k}").alias(k) for k in (
            "title", "severity", "icon", "description", "types", "impacts", "mitigations",
            "examples",
        )],
    )


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A static reference table (risks or attack demos) kept as JSON lines; a missing path is empty."""
    return there_or_empty(lambda: spark.read.schema(schema).json(path), lambda: spark.createDataFrame([], schema))


CATALOG_SCHEMA = "priority int, id string, label string, url string, source string"


def source_catalog(spark: SparkSession, entries: Iterable[dict[str, str]]) -> DataFrame:
    """Data sources ``(priority, id, label, url, source)`` from configuration entries."""
    rows = [
        (n, e.get("id"), e.get("label"), e.get("url"), e.get("source"))
        for n, e in enumerate(entries)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def read_source_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON file with a ``data_sources`` list; a missing file has no sources."""
    entry = "array<struct<id:string,label:string,url:string,source:string>>"
    return there_or_empty(
        lambda: spark.read.schema(f"data_sources {entry}").option("multiLine", True).json(path)
        .select(F.posexplode("data_sources").alias("priority", "e"))
        .select("priority", "e.*"),
        lambda: spark.createDataFrame([], CATALOG_SCHEMA),
    )


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Guidance pages listed in a sitemap."""
    locations = (
        spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
        .select(strip(F.col("loc")).alias("url"))
        .filter("url is not null and url != ''")
    )
    marked = [F.col("url").contains(m) for m in fixed.SITEMAP_MARKS]
    title = title_from_url(F.col("url"))
    return locations.filter(marked[0] | marked[1]).select(
        slugify(title).alias("id"),
        strip(title).alias("title"),
        "url",
        category_of(title, F.col("url")).alias("category"),
    )


def _as_text(data: bytes) -> pa.Array:
    """One string over the bytes of a file, without a copy where all of them are UTF-8; others are dropped."""
    ends = pa.array([0, len(data)], pa.int32()).buffers()[1]
    try:
        return pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(data)]).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([data.decode(errors="ignore")], pa.string())


def read_text_files(requested: DataFrame) -> DataFrame:
    """Whole files for the distinct ``path`` values: ``(path, content, error)``.

    Tasks open exactly the requested paths, whatever their names, and nothing else in the
    folders. What cannot be read has an error and no content; bytes that are not UTF-8
    are dropped. Null paths are left out. Paths are dealt to a fixed number of tasks: as few bytes as they are,
    adaptive execution would put all of them, and so all files, into one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content, error = pa.nulls(1, pa.string()), None
                try:
                    store, local = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(local) as stream:
                        content = _as_text(stream.readall())
                except (OSError, pa.ArrowException) as failed:
                    error = f"cannot read {path}: {type(failed).__name__}"
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "content": content, "error": pa.array([error], pa.string())}
                )

    tasks = int(requested.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = requested.select("path").filter("path is not null").repartition(tasks, "path").distinct()
    return paths.mapInArrow(read, "path string, content string, error string")


def read_binary_text(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as text; bytes that are not UTF-8 are dropped."""
    return spark.read.format("binaryFile").load(path).select(
        _file_name().alias("file_name"), decode_lossy(F.col("content")).alias("content")
    )


REPORT_FILES = "file_name string, generated_at timestamp, content string"


def read_reports(spark: SparkSession, directory: str) -> DataFrame:
    """Markdown reports kept as files: name, time in the name, content; missing folder -> empty.

    Order by ``file_name`` where the newest must come first.
    """
    return there_or_empty(
        lambda: spark.read.option("pathGlobFilter", "*.md")
        .option("recursiveFileLookup", True)
        .text(directory, wholetext=True)
        .select(
            _file_name().alias("file_name"),
            report_timestamp(_file_name()).alias("generated_at"),
            F.col("value").alias("content"),
        ),
        lambda: spark.createDataFrame([], REPORT_FILES),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """Append ``(report_name, report)`` to the report table, partitioned by the day in the name."""
    stamped = reports.select(
        F.col("report_name").alias("file_name"),
        report_timestamp(F.col("report_name")).alias("generated_at"),
        F.col("report").alias("content"),
    )
    day = F.coalesce(F.to_date("generated_at").cast("string"), F.lit("undated"))
    stamped.withColumn("day", day).write.partitionBy("day").mode("append").parquet(path)


def read_report_table(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_reports` stored, in the columns of :func:`read_reports`; a name written
    twice counts once, with the larger content."""
    stored = there_or_empty(
        lambda: spark.read.schema(f"{REPORT_FILES}, day string").parquet(path).drop("day"),
        lambda: spark.createDataFrame([], REPORT_FILES),
    )
    return last_per_key(stored, ["file_name"], ["content"])


def write_json_by_slug(
    records: DataFrame, path: str, slug_source: str, default: str, order_by: str, buckets: int = 64
) -> None:
    """JSON lines with their slug in at most ``buckets`` folders by hash of the slug.

    Of records with one slug the last by ``order_by`` stays. Stored records of other slugs stay
    too; only the buckets that ``records`` touch are written again.
    """
    slug = slugify_ascii(F.col(slug_source), default)
    fresh = last_per_key(records.withColumn("slug", slug), ["slug"], [order_by])
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int"))
    stored = there_or_empty(
        lambda: records.sparkSession.read.schema(fresh.schema).json(path),
        lambda: fresh.filter(F.lit(False)),
    )
    kept = stored.join(fresh.select("bucket").distinct(), "bucket", "left_semi").join(
        fresh.select("slug"), "slug", "left_anti"
    )
    # The buckets are read and written again, so the result is stored before it replaces them.
    merged = materialise(kept.unionByName(fresh), "json-by-slug")
    (
        merged.repartition("bucket")
        .write.partitionBy("bucket")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .json(path)
    )


def write_review_state(states: DataFrame, path: str) -> None:
    states.write.mode("overwrite").json(path)


def review_state_json(states: DataFrame) -> DataFrame:
    """The full state of each review as one JSON text."""
    fields = F.struct(*states.columns)
    return states.select("id", F.to_json(fields).alias("state"))
