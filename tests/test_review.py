"""Guardrails, routing, scans and reports."""

import json

import pytest
from pyspark.sql import functions as F

from beaconry.plans import review
from tests import fixtures
from tests.conftest import rows


def vuln(level):
    return {"description": "d", "risk_level": level, "evidence": "e"}


def body(levels, highest="high", **extra):
    return json.dumps({"security_vulnerabilities": [vuln(x) for x in levels], "highest_risk": highest, **extra})


CASES = {
    "match": (body(["low", "HIGH"]), True, "high", True),
    "repaired": (body(["low", "medium"], "high"), True, "medium", False),
    "missing_highest": (json.dumps({"security_vulnerabilities": [vuln("low")]}), True, "low", False),
    "unknown_highest": (body(["low"], "severe"), True, "low", False),
    "no_list": (json.dumps({"highest_risk": "low"}), False, None, True),
    "null_level": (body([None]), False, None, False),
    "bad_level": (body(["urgent"]), False, None, False),
    "empty_list": (body([], "Medium"), True, "Medium", True),
    "not_json": ("hello {", False, None, False),
    "empty_object": ("{}", False, None, False),
    "null": (None, False, None, False),
}


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame([(n, c[0]) for n, c in CASES.items()], "name string, raw string")


def test_guardrail_fix(reviews):
    found = {r.name: r for r in review.guardrail_fix(reviews, "raw").collect()}
    for name, (_, ok, highest, _) in CASES.items():
        assert found[name].ok == ok, name
        assert (found[name].reason is None) == ok
        if ok:
            assert found[name].fixed.highest_risk == highest, name
    assert found["null_level"].reason == "bad_level:"
    assert found["no_list"].reason == "missing_list"
    assert found["not_json"].reason == found["null"].reason == "missing_json"


def test_guardrail_strict(reviews):
    found = {r.name: r for r in review.guardrail_strict(reviews, "raw").collect()}
    for name, (_, _, _, ok) in CASES.items():
        assert found[name].ok == ok, (name, found[name].reason)
    assert found["null_level"].reason == "bad_level:"
    assert found["missing_highest"].reason == "missing_highest"


def test_routing_and_decisions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    none = F.lit(None).cast("string")
    assert one(review.decision_ok(F.lit("I DISAPPROVE"))) is True
    assert one(review.decision_ok(F.lit("maybe"))) is False
    assert one(review.route_change(F.array(F.lit("e")), F.lit("COMPLEX"))) == "ERROR"
    assert one(review.route_change(F.array(), F.lit("rather complex"))) == "COMPLEX"
    assert one(review.route_change(F.array(), none)) == "SIMPLE"
    assert one(review.decide(F.lit(86), F.lit(False), F.lit("low"))) == "approve"
    assert one(review.decide(F.lit(85), F.lit(None).cast("boolean"), none)) == "request changes"
    assert one(review.decide(F.lit(99), F.lit(False), F.lit("high"))) == "escalate"
    assert one(review.failed_rules({"a": F.lit(True), "b": F.lit(None).cast("boolean")})) == ["b"]


RULES = [
    review.Rule("secret", "A07", "Hard-coded secret", r"(?i)(?:key|secret)\s*=\s*\"[^\"]+\"", "high", "Use a vault"),
    review.Rule("sql", "A03", "String-built SQL", r"select [^\n]*\" \+", "medium", "Bind parameters"),
    review.Rule("debug", "A05", "Debug server", r"debug=True", "low", "Turn it off"),
]


def test_rule_scan(spark):
    diffs = spark.createDataFrame(
        [("bad", fixtures.DIFF_INSECURE), ("fine", fixtures.DIFF_RENAME)], "name string, content string"
    )
    found = {r.name: r for r in review.rule_scan(diffs, "name", "content", RULES).collect()}
    assert [f.rule_id for f in found["bad"].findings] == ["secret", "sql", "debug"]
    assert found["bad"].blocking and found["bad"].highest_risk == "high"
    assert found["fine"].findings == [] and found["fine"].highest_risk is None and not found["fine"].blocking
    plan = review.rule_scan(diffs, "name", "content", RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_payload_caps_many_parts(spark):
    parts = [("k", n, "x" * (n % 7)) for n in range(3_000)] + [("one", 0, "y" * 200), ("edge", 0, "z" * 50), ("edge", 1, "")]
    df = spark.createDataFrame(parts, "k string, n bigint, t string")
    for limit in (52, 100, 5_000):
        got = {r.k: r.content for r in review.content_parts(df, "k", "n", F.col("t"), limit, chunk=100).collect()}
        for key in ("k", "one", "edge"):
            whole = "\n\n".join(t for k, _, t in sorted(parts, key=lambda p: p[1]) if k == key)
            want = whole[:limit] + "\n\n[Truncated to fit context limit]" if len(whole) > limit else whole
            assert got[key] == want, (key, limit)


def test_report_round_trip(spark):
    fixes = F.array(F.struct(F.lit("d").alias("description"), F.lit("s").alias("solutions"), F.lit("x").alias("explanation")))
    row = spark.range(1).select(
        F.lit("code_review_20260101_101010.md").alias("file_name"),
        review.render_report(F.lit("2026-01-01T10:10:10"), F.lit("Own sheet"), F.lit("text"), F.lit(30), fixes, F.lit("r")).alias("content"),
    )
    old = row.select(
        F.lit("code_review_20250101_101010.md").alias("file_name"),
        F.regexp_replace("content", "Selected guidance: [^\n]*\n", "").alias("content"),
    )
    got = rows(review.parse_reports(row.unionByName(old)), "file_name", "guidance", "confidence", "fix_count")
    assert got == [("code_review_20250101_101010.md", None, 30, 1), ("code_review_20260101_101010.md", "Own sheet", 30, 1)]


def test_hooks_and_fan_in(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    hooked = review.apply_hooks(base, lambda d: d.withColumn("n", F.length("t")), lambda d: d.filter("id = 1"))
    assert rows(hooked) == [(1, "a", 1)]
    assert rows(review.review_fan_in(base, hooked.select("id", "n"), "id")) == [(1, "a", 1)]
