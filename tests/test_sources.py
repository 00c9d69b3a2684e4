"""Readers and writers on files of a temporary folder."""

import json

from pyspark.sql import functions as F

from beaconry.operators.firsts import first_match
from beaconry.sources import documents as docs
from beaconry.sources import schemas
from tests import fixtures
from tests.conftest import rows

RISK = {"id": "R1", "title": "T", "severity": "hIgh", "types": [["a", "b"], ["c"]], "impacts": ["i"]}


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def test_sheet_json(spark, tmp_path):
    folder = put(tmp_path / "sheets", "b.json", json.dumps({"id": "s", "title": "S", "url": "u", "risks": [RISK]}))
    put(tmp_path / "sheets", "a.json", json.dumps({"id": "a", "title": "A", "url": "u", "category": "Api"}))
    put(tmp_path / "sheets", "c.json", '{"id": "broken"')
    put(tmp_path / "sheets", "d.json", '{"id": "no title"}')
    put(tmp_path / "sheets", "notes.txt", "x")
    sheets = docs.read_sheet_json(spark, folder).orderBy("file_name").collect()
    assert [s.file_name for s in sheets] == ["a.json", "b.json"]
    assert (sheets[0].category, sheets[1].category) == ("Api", "General")
    risk = sheets[1].risks[0]
    assert risk.severity == "High" and risk.icon == "⚠️" and risk.mitigations == []
    assert [tuple(t) for t in risk.types] == [("a", "b"), ("c", "")]
    assert sheets[0].risks == [] and sheets[0].tags == []
    assert rows(docs.read_bad_sheets(spark, folder), "file_name") == [("c.json",), ("d.json",)]
    assert docs.read_sheet_json(spark, str(tmp_path / "none")).count() == 0


def test_numbered_risk_json(spark, tmp_path):
    body = {"id": "top", "title": "T", "source_url": "u", "risks": {"A02": RISK, "A01": {"title": "Only"}}}
    folder = put(tmp_path / "top", "top.json", json.dumps(body))
    put(tmp_path / "top", "bad.json", "[1")
    found = docs.read_numbered_risk_json(spark, folder).orderBy("file_name", "risk_id").collect()
    assert [(r.source_id, r.risk_id, r.title, r.severity) for r in found] == [
        ("top", "A01", "Only", "Medium"), ("top", "A02", "T", "High"),
    ]


def test_reference_and_catalog(spark, tmp_path):
    line = json.dumps({"risk_id": "L1", "title": "Demo", "goal": "g"})
    put(tmp_path / "ref", "r.json", line + "\n" + line.replace("L1", "L2"))
    demos = docs.read_reference(spark, str(tmp_path / "ref"), "risk_id string, title string, goal string")
    assert rows(demos, "risk_id") == [("L1",), ("L2",)]
    entries = [
        {"id": "web", "label": "Web list", "url": "u", "source": "web"},
        {"id": "own", "label": "Own list", "url": "", "source": "static"},
    ]
    catalog = docs.source_catalog(spark, entries)
    assert first_match(catalog, F.col("label") == "Own list", ["priority"]).first().id == "own"
    assert first_match(catalog, F.col("label") == "?", ["priority"]).first().id == "web"
    assert docs.source_catalog(spark, []).count() == 0


def test_sitemap(spark, tmp_path):
    folder = put(tmp_path / "map", "sitemap.xml", fixtures.SITEMAP)
    assert rows(docs.read_sitemap(spark, folder)) == [
        ("file-upload", "File Upload", "https://g.example.org/cheatsheets/File_Upload_Cheat_Sheet.html", "File"),
        ("plain-page", "plain page", "https://g.example.org/cheatsheets/plain-page.html", "Web Security"),
    ]


def test_text_files_and_errors(spark, tmp_path):
    folder = put(tmp_path / "diffs", "a.diff", fixtures.DIFF_RENAME)
    put(tmp_path / "diffs", "unasked.diff", "x")
    asked = spark.createDataFrame(
        [(f"{folder}/a.diff",), (f"{folder}/gone.diff",), (str(tmp_path / "no/b.diff"),)], "path string"
    )
    got = docs.read_text_files(asked)
    assert rows(got.filter("error is null"), "path", "content") == [(f"{folder}/a.diff", fixtures.DIFF_RENAME)]
    failed = rows(got.filter("error is not null"), "path", "content")
    assert failed == [(f"{folder}/gone.diff", None), (str(tmp_path / "no/b.diff"), None)]
    for name in ("with blank.diff", "_under.diff"):
        put(tmp_path / "diffs", name, name)
    odd = spark.createDataFrame([(f"{folder}/with blank.diff",), (f"{folder}/_under.diff",), (None,)], "path string")
    assert [r[0] for r in rows(docs.read_text_files(odd), "content")] == ["_under.diff", "with blank.diff"]
    put(tmp_path / "bin", "x.bin", b"a\xffb")
    assert rows(docs.read_binary_text(spark, str(tmp_path / "bin"))) == [("x.bin", "ab")]


def test_bytes_of_a_file_as_text():
    for data in (b"", b"abc\n", "é\ufeff\U0001f600".encode(), b"a\xffb", b"\xed\xa0\x80x", "é".encode()[:1]):
        assert docs._as_text(data).to_pylist() == [data.decode(errors="ignore")]


def test_text_files_are_read_in_several_tasks(spark, tmp_path):
    for n in range(40):
        folder = put(tmp_path / "many", f"{n}.diff", str(n))
    asked = spark.createDataFrame([(f"{folder}/{n % 40}.diff",) for n in range(80)], "path string")
    read = docs.read_text_files(asked).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(int(r.content) for r in read) == list(range(40))
    assert len({r.task for r in read}) > 1


def test_reports_round_trip(spark, tmp_path):
    target = str(tmp_path / "reports")
    assert docs.read_reports(spark, target).count() == 0
    put(tmp_path / "reports", "code_review_20260101_101010.md", "older")
    put(tmp_path / "reports", "code_review_20260102_101010.md", "newer")
    found = docs.read_reports(spark, target).orderBy(F.desc("file_name")).collect()
    assert [r.content for r in found] == ["newer", "older"]
    assert str(found[0].generated_at) == "2026-01-02 10:10:10"
    out = str(tmp_path / "written")
    assert docs.read_report_table(spark, out).count() == 0
    names = ["code_review_20260101_101010.md", "code_review_20260102_101010.md", "code_review_x.md"]
    report = spark.createDataFrame([(n, f"line\n{n}") for n in names], "report_name string, report string")
    docs.write_reports(report, out)
    docs.write_reports(report, out)
    assert rows(docs.read_report_table(spark, out), "file_name", "content") == [(n, f"line\n{n}") for n in names]


def test_source_catalog_file(spark, tmp_path):
    folder = put(tmp_path / "conf", "sources.json", '{"data_sources": [{"id": "a", "label": "A", "url": "u", "source": "web"}, {"id": "b"}]}')
    got = rows(docs.read_source_catalog(spark, f"{folder}/sources.json"), "priority", "id", "source")
    assert got == [(0, "a", "web"), (1, "b", None)]
    assert docs.read_source_catalog(spark, f"{folder}/none.json").count() == 0


def test_json_by_slug(spark, tmp_path):
    target = str(tmp_path / "out")
    first = spark.createDataFrame([("My Sheet", 1), ("my  sheet!", 2), ("Other", 3)], "title string, n int")
    docs.write_json_by_slug(first, target, "title", "sheet", "n")
    docs.write_json_by_slug(first.filter("n = 3").withColumn("n", F.lit(4)), target, "title", "sheet", "n")
    long = spark.createDataFrame([("x" * 90 + end, 1) for end in "ab"], "title string, n int")
    docs.write_json_by_slug(long, target, "title", "sheet", "n")
    back = spark.read.schema("title string, n int, slug string").json(target)
    assert rows(back.filter("length(slug) < 80"), "slug", "n") == [("my-sheet", 2), ("other", 4)]
    assert back.filter("length(slug) = 80").select("slug").distinct().count() == 2


def test_review_state(spark, tmp_path):
    state = spark.sql("SELECT 'r' id, 'p' pr_file_path, array('e') errors")
    docs.write_review_state(state, str(tmp_path / "state"))
    back = spark.read.schema(schemas.REVIEW_STATE).json(str(tmp_path / "state")).first()
    assert (back.id, back.errors, back.tokens_used) == ("r", ["e"], None)
    assert json.loads(docs.review_state_json(state).first().state)["errors"] == ["e"]
