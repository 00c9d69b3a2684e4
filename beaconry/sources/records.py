"""Records of unsure shape: YAML lists, JSON whose field types are checked, and canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.functions.text import strip
from beaconry.sources import schemas
from beaconry.sources.documents import CATALOG_SCHEMA, normalise_risk_map, normalise_sheets, there_or_empty

#: Variant types a field may have; a list may be empty, an optional field null or absent.
TEXT, TEXTS, OBJECTS = ("STRING",), ("ARRAY<STRING>", "ARRAY<VOID>"), ("ARRAY<OBJECT", "ARRAY<VOID>")
SHEET_FIELDS: Mapping[str, Sequence[str]] = {
    **dict.fromkeys(("id", "title", "url", "description", "category", "icon", "introduction", "last_updated", "raw_markdown"), TEXT),
    **dict.fromkeys(("contributors", "related_cheatsheets", "tags"), TEXTS),
    **dict.fromkeys(("sections", "risks", "attack_examples"), OBJECTS),
}
SHEET_NEEDS = ("id", "title", "url")
CATALOG_COLUMNS = [part.split()[0] for part in CATALOG_SCHEMA.split(", ")]
RISK_SET_FIELDS = {"id": TEXT, "title": TEXT, "source_url": TEXT, "risks": ("OBJECT<",)}


@F.arrow_udf(T.StringType())
def _yaml_as_json(column: pa.Array) -> pa.Array:
    """YAML documents as JSON text; null where a document is none."""
    import yaml

    def converted(text: str | None) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text or ""), default=str)
        except yaml.YAMLError:
            return None

    return pa.array([converted(text) for text in column.to_pylist()], pa.string())


def read_yaml_records(spark: SparkSession, path: str, field: str, entry: str) -> DataFrame:
    """Entries of the list ``field`` of every YAML document below ``path``, with their place.

    ``(file_name, document, priority, entry fields..., reason)``; ``entry`` is a DDL of named fields.
    Documents end at ``---`` lines, so a large file is split like any text. A document that cannot
    be read gives one row with a reason, one without the list nothing; a missing path is empty.
    """
    schema = f"struct<`{field}`:array<struct<{entry}>>>"
    empty = f"file_name string, document bigint, priority int, {entry}, reason string"

    def read() -> DataFrame:
        documents = spark.read.option("lineSep", "\n---\n").text(path).select(
            F.col("_metadata.file_name").alias("file_name"),
            F.monotonically_increasing_id().alias("document"), _yaml_as_json("value").alias("json"),
        )
        parsed = documents.withColumn("e", F.from_json("json", schema)[field])
        good = parsed.select("file_name", "document", F.posexplode("e").alias("priority", "entry"))
        bad = documents.filter("json is null").select("file_name", "document", F.lit("not YAML").alias("reason"))
        return good.select("file_name", "document", "priority", "entry.*", F.lit(None).cast("string").alias("reason")).unionByName(
            bad, allowMissingColumns=True
        )

    return there_or_empty(read, lambda: spark.createDataFrame([], empty))


def yaml_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Data sources ``(priority, id, label, url, source)`` from YAML; a missing file has none."""
    found = read_yaml_records(spark, path, "data_sources", "id string, label string, url string, source string")
    return found.filter("reason is null").select(*CATALOG_COLUMNS)


def checked_records(
    spark: SparkSession,
    path: str,
    fields: Mapping[str, Sequence[str]],
    needs: Sequence[str],
    whole_files: bool = True,
) -> DataFrame:
    """``(file_name, text, record, reasons)`` of JSON files, or of JSON lines.

    ``record`` is a VARIANT, so a field of an odd type spoils neither its record nor the
    others: each is judged by its own type, and ``reasons`` lists what is wrong, in the order of the
    fields. Unknown fields are let through. A missing folder is empty; a file without a byte has no row.
    """
    def read() -> DataFrame:
        lines = spark.read.option("pathGlobFilter", "*.json") if whole_files else spark.read
        text = lines.text(path, wholetext=whole_files).select(
            F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
        )
        return text if whole_files else text.filter(strip(F.col("text")) != "")

    rows = there_or_empty(read, lambda: spark.createDataFrame([], "file_name string, text string"))
    parsed = rows.withColumn("record", F.try_parse_json("text"))
    kind = F.schema_of_variant("record")

    def problem(name: str, allowed: Sequence[str]) -> Column:
        value = F.try_variant_get("record", f"$.{name}", "variant")
        shape = F.schema_of_variant(value)
        absent = value.isNull() | (shape == "VOID")
        fits = F.lit(False)
        for prefix in allowed:
            fits |= shape.startswith(prefix)
        missing = F.lit(f"{name}: missing") if name in needs else F.lit(None).cast("string")
        return F.when(absent, missing).when(~fits, F.concat(F.lit(f"{name}: "), F.lower(F.regexp_extract(shape, "^[A-Z]+", 0))))

    wrong = F.array_compact(F.array(*[problem(name, allowed) for name, allowed in fields.items()]))
    reasons = (
        F.when(F.col("record").isNull(), F.array(F.lit("not JSON")))
        .when(~kind.startswith("OBJECT"), F.array(F.lit("not an object")))
        .otherwise(wrong)
    )
    return parsed.withColumn("reasons", reasons)


def split_sheets(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sheets whose fields all have their types, normalised, and ``(file_name, text, reasons)`` of the rest."""
    checked = checked_records(spark, path, SHEET_FIELDS, SHEET_NEEDS, whole_files)
    good = checked.filter(F.size("reasons") == 0).select("file_name", F.from_json("text", schemas.SHEET).alias("s"))
    return (
        normalise_sheets(good.select("s.*", "file_name")),
        checked.filter(F.size("reasons") > 0).select("file_name", "text", "reasons"),
    )


def split_risk_sets(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same for numbered-risk files: risk rows, and the rejected records."""
    checked = checked_records(spark, path, RISK_SET_FIELDS, ("risks",), whole_files)
    good = checked.filter(F.size("reasons") == 0).select("file_name", F.from_json("text", schemas.NUMBERED_RISKS).alias("s"))
    return (
        normalise_risk_map(good.select("s.*", "file_name")),
        checked.filter(F.size("reasons") > 0).select("file_name", "text", "reasons"),
    )


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of structs and the keys of maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        made = F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")),
        )
        by_key = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(by_key)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    return value


def canonical_json(rows: DataFrame, columns: Sequence[str]) -> Column:
    """JSON of the columns that is the same for any order of columns, struct fields and map keys; nulls are written."""
    parts = [canonical(F.col(c), rows.schema[c].dataType).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def canonical_hash(rows: DataFrame, columns: Sequence[str]) -> Column:
    """First 16 hex digits of SHA-256 over :func:`canonical_json`."""
    return F.substring(F.sha2(canonical_json(rows, columns), 256), 1, 16)
