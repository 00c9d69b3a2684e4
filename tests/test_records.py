"""YAML lists, checked JSON records and canonical forms on files of a temporary folder."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from beaconry.sources import records
from tests.conftest import rows
from tests.test_sources import RISK, put

CONFIG = """# own sources
data_sources:
  - {id: web, label: "Web: list", url: u, source: web}
  - id: own
    label: |-
      two
      lines
    source: static
other: [1, 2]
"""


def test_yaml_catalog(spark, tmp_path):
    folder = put(tmp_path / "conf", "a.yaml", CONFIG)
    assert rows(records.yaml_catalog(spark, folder), "priority", "id", "label", "url") == [
        (0, "web", "Web: list", "u"), (1, "own", "two\nlines", None),
    ]
    assert records.yaml_catalog(spark, str(tmp_path / "none.yaml")).count() == 0
    put(tmp_path / "conf", "b.yaml", "data_sources: []\n---\ndata_sources:\n- id: late\n---\nkey: [broken\n---\n- no map\n---\n")
    found = records.read_yaml_records(spark, folder, "data_sources", "id string")
    assert rows(found.filter("reason is null"), "file_name", "priority", "id") == [
        ("a.yaml", 0, "web"), ("a.yaml", 1, "own"), ("b.yaml", 0, "late"),
    ]
    assert rows(found.filter("reason is not null"), "file_name", "reason") == [("b.yaml", "not YAML")]


def test_sheets_of_a_folder_with_bad_files(spark, tmp_path):
    sheets = {
        "ok.json": {"id": "a", "title": "A", "url": "u", "tags": ["x"], "risks": [RISK], "unknown": {"deep": [1]}},
        "null.json": {"id": "n", "title": "N", "url": "u", "tags": None, "description": None},
        "none.json": {"title": "N"},
        "odd.json": {"id": 5, "title": True, "url": "u", "tags": {"a": 1}, "sections": "s", "contributors": ["a", 1]},
        "list.json": [1],
    }
    for name, body in sheets.items():
        put(tmp_path / "sheets", name, json.dumps(body, indent=1))
    put(tmp_path / "sheets", "cut.json", '{"id": "c", "title"')
    put(tmp_path / "sheets", "empty.json", "\n")
    folder = put(tmp_path / "sheets", "notes.txt", "{}")
    good, bad = records.split_sheets(spark, folder)
    assert rows(good, "file_name", "id", "category") == [("null.json", "n", "General"), ("ok.json", "a", "General")]
    kept = good.filter("id = 'a'").first()
    assert kept.tags == ["x"] and kept.risks[0].severity == "High" and kept.description == ""
    assert {r.file_name: r.reasons for r in bad.collect()} == {
        "none.json": ["id: missing", "url: missing"],
        "odd.json": ["id: bigint", "title: boolean", "contributors: array", "tags: object", "sections: string"],
        "list.json": ["not an object"], "cut.json": ["not JSON"], "empty.json": ["not JSON"],
    }
    for frame in records.split_sheets(spark, str(tmp_path / "nowhere")):
        assert frame.count() == 0


def test_risk_sets(spark, tmp_path):
    put(tmp_path / "top", "t.json", json.dumps({"id": "top", "title": "T", "risks": {"A02": RISK, "A01": {"title": "Only"}}}))
    folder = put(tmp_path / "top", "bad.json", json.dumps({"id": "x", "risks": [RISK]}))
    good, bad = records.split_risk_sets(spark, folder)
    assert rows(good, "source_id", "risk_id", "title", "severity") == [("top", "A01", "Only", "Medium"), ("top", "A02", "T", "High")]
    assert rows(bad, "file_name", "reasons") == [("bad.json", ["risks: array"])]


@pytest.mark.parametrize("order", [("a", "b"), ("b", "a")])
def test_canonical_json(spark, order):
    body = {"b": F.create_map(F.lit("z"), F.array(F.lit(1), F.lit(None)), F.lit("a"), F.lit(None)), "a": F.lit(None).cast("struct<y:int,x:int>")}
    inner = F.struct(*[body[k].alias(k) for k in order])
    frame = spark.range(1).select(inner.alias("v"), F.lit("é\"").alias("t"), F.array(inner, F.lit(None)).alias("list"))
    want = {"a": None, "b": {"a": None, "z": [1, None]}}
    text = json.dumps({"list": [want, None], "t": 'é"', "v": want}, ensure_ascii=False, separators=(",", ":"))
    row = frame.select(records.canonical_json(frame, ["v", "t", "list"]).alias("j"), records.canonical_hash(frame, ["t", "list", "v"]).alias("h")).first()
    assert row.j == text
    assert row.h == hashlib.sha256(text.encode()).hexdigest()[:16]
