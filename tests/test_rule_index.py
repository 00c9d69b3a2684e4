"""Scans by a rule table: equal to a regex per rule, and hardly dearer with a hundred times the rules."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from beaconry.plans import review, rule_index as ri

FIELDS = "rule_id string, category_id string, description string, pattern string, risk_level string, advice string"


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("password", ["password"]), ("(?i)PassWord\\s*=", ["password", "="]), ("ab?cde*fgh", ["a", "cd", "fgh"]),
        ("eval\\(x+y", ["eval(x", "y"]), ("foo|bar", []), ("(?:foo|bar)baz", ["baz"]), ("a{2}bcd", ["bcd"]),
        ("[a-z]+key[]x)]end", ["key", "end"]), ("x\\Q.*\\E", []), ("(?x) a b c", []), ("(?iu)asking", ["a", "ing"]),
        ("\\bsecret\\w+_id", ["secret", "_id"]), ("café au lait", ["caf", " au lait"]), ("tok\\x65n|a", []), ("a(b[)]c)?def", ["a", "def"]),
        ("ab+?cd", ["ab", "cd"]), ("", []), ("\\d{3,}", []),
    ],
)
def test_required_literals(pattern, literals):
    assert ri.required_literals(pattern) == literals


def some_rules(count, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(count)]
    shapes = ["{w}", "(?i){w}[a-z]*", "{w}\\s+\\w+", "(?:{w}|zz)", "[0-9]{{2}}{w}", "{w}|q{w}", "a?{w}", "\\b{w}\\b", "é?{w}"]
    return [
        (f"r{n:05}", "A01", "d", rng.choice(shapes).format(w=w), rng.choice(["high", "medium", "low"]), f"fix {n % 7}")
        for n, w in enumerate(words)
    ]


def some_texts(count, seed=2):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choices("abcdefghijABé9", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 80))) for _ in range(count)]
    return list(enumerate([*texts, "", None, "ab", "é", "zz", "x" * 100_000 + "zz"]))


def test_table_scan_equals_a_regex_per_rule(spark):
    rules = some_rules(120)
    texts = spark.createDataFrame(some_texts(150), "k int, t string")
    want = review.rule_scan(texts, "k", "t", [review.Rule(*r) for r in rules])
    for partitions, sample in ((1, 1_000), (5, 3)):
        got = ri.rule_table_scan(texts.repartition(partitions), "k", "t", spark.createDataFrame(rules, FIELDS), sample)
        shown = lambda df: sorted((r.k, [tuple(f) for f in r.findings], r.highest_risk, r.blocking, r.recommendations) for r in df.collect())
        assert shown(got) == shown(want)


def test_two_thousand_rules_against_plain_search_and_their_time(spark):
    # Word boundaries beside letters beyond ASCII differ between the two regex dialects.
    rules = [r for r in some_rules(2_800, 5) if "é" not in r[3] and "\\b" not in r[3]][:2_000]
    data = some_texts(300, 6)
    texts = spark.createDataFrame(data, "k int, t string").repartition(4).cache()
    texts.count()

    def timed(count):
        table = spark.createDataFrame(rules[:count], FIELDS).cache()
        table.count()
        started = time.perf_counter()
        rows = ri.rule_table_scan(texts, "k", "t", table).select("k", F.explode("findings").alias("f")).select("k", "f.*").collect()
        return rows, time.perf_counter() - started

    timed(20)
    _, few = timed(20)
    rows, many = timed(len(rules))
    found = {(r.k, r.rule_id): r.evidence for r in rows}
    want = {(k, r[0]): m[0] for r in rules for k, t in data if (m := re.search(r[3], t or "", re.ASCII)) and m[0]}
    assert len(rules) == 2_000 and found == want
    assert many < 6 * few + 2  # a hundred times the rules


def test_texts_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ri, "SLICE_BYTES", 50)
    texts = spark.createDataFrame(some_texts(40), "k int, t string")
    rules = spark.createDataFrame(some_rules(30), FIELDS)
    found = ri.rule_table_scan(texts, "k", "t", rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert sum(len(r.findings) for r in found.collect()) == sum(
        len(r.findings) for r in review.rule_scan(texts, "k", "t", [review.Rule(*r) for r in some_rules(30)]).collect()
    )


def test_no_rules_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "abc")], "k int, t string")
    rules = spark.createDataFrame([], FIELDS)
    row = ri.rule_table_scan(texts, "k", "t", rules).first()
    assert (row.findings, row.highest_risk, row.blocking) == ([], None, False)
    assert ri.rule_table_scan(texts.filter("k > 1"), "k", "t", rules).collect() == []
