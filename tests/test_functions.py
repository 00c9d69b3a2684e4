"""Column rules on tricky single values."""

import pytest
from pyspark.sql import functions as F

from beaconry.functions import classify, fixed_values, keys, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, clean, slug",
    [
        ("Café_Über  Cheat Sheet ¶", "Café_Über", "café-über"),
        ("Access Control – Gatehouse notes", "Access Control", "access-control"),
        ("  A -- B__C! ", "A -- B__C!", "a-b-c"),
        ("Cheat Sheet", "", ""),
    ],
)
def test_titles(spark, raw, clean, slug):
    assert one(spark, text.clean_title(F.lit(raw), "Gatehouse")) == clean
    assert one(spark, text.slugify(F.lit(clean))) == slug


def test_slug_defaults_and_cut(spark):
    assert one(spark, text.slugify_ascii(F.lit(" ÄÖ "), "sheet")) == "sheet"
    assert len(one(spark, text.slugify_ascii(F.lit("a" * 200), "x"))) == 80


@pytest.mark.parametrize(
    "href, url",
    [
        ("x.html", "https://h.org/d/x.html"),
        ("../x/./y?q=1", "https://h.org/x/y?q=1"),
        ("/a/../b", "https://h.org/b"),
        ("//cdn/x", "https://cdn/x"),
        ("mailto:a@b", "mailto:a@b"),
        ("#f", "https://h.org/d/p.html?z#f"),
        ("?n=2", "https://h.org/d/p.html?n=2"),
        ("", "https://h.org/d/p.html?z"),
        ("..", "https://h.org/"),
    ],
)
def test_resolve_url(spark, href, url):
    assert one(spark, urls.resolve_url(F.lit("https://h.org/d/p.html?z"), F.lit(href))) == url
    assert one(spark, urls.resolve_url(F.lit("https://h.org"), F.lit("a/b"))) == "https://h.org/a/b"


def test_category_order_traps(spark):
    def category(title, url=""):
        return one(spark, classify.category_of(F.lit(title), F.lit(url)))

    assert category("NoSQL stores") == "Sql"
    assert category("REST API") == "Api"
    assert category("Login page") == "Authentication"
    assert category("Hashing", "page.html") == "Cryptography"
    assert category("Hashing", "https://x.org") == "Web Security"
    assert category("Other", "x") == "General"
    assert category("CI/CD") == "Ci/cd"


def test_severity_is_a_substring_rule(spark):
    assert one(spark, classify.assess_severity(F.lit("Allow this"))) == "Low"
    assert one(spark, classify.assess_severity(F.lit("Allow this"), word_boundary=True)) == "Medium"
    assert one(spark, classify.assess_severity(F.lit("minor but IMPORTANT"))) == "High"
    assert one(spark, classify.normalize_severity(F.lit(" hIGH "))) == "High"
    assert one(spark, classify.normalize_severity(F.lit(None).cast("string"))) == "Medium"


def test_clean_description(spark):
    raw = "Keep this prose line.\n\n\n\nimport os\n```\ncode\n``` and `x` more  words\nkey = \"v\": 1\nend;"
    assert one(spark, text.clean_description(F.lit(raw))) == "Keep this prose line.\n\n and more words"
    assert one(spark, text.clean_description(F.lit(""))) == ""
    assert one(spark, text.clean_description(F.lit("{a}"))) == fixed_values.EMPTY_DESCRIPTION


def test_recommendations_keep_first_place(spark):
    raw = (
        "Never trust remote clients at all. You should validate all the input here. "
        "Because we must validate them. You must validate all the input here. Avoid it."
    )
    got = one(spark, text.recommendations(F.lit(raw)))
    assert got == [
        "validate all the input here.", "we must validate them.", "trust remote clients at all.",
    ]


def test_small_rules(spark):
    assert one(spark, text.capitalize(F.lit("cI/CD x"))) == "Ci/cd x"
    assert one(spark, text.display_title(F.lit("access-control"))) == "Access Control"
    assert one(spark, text.decode_lossy(F.unhex(F.lit("61FF62")))) == "ab"
    assert one(spark, text.meta_keywords(F.lit("A, ,b C"))) == ["a", "b c"]
    assert one(spark, keys.risk_id(F.lit("access-control"), F.lit(101))) == "ACCESS101"
    assert one(spark, keys.report_timestamp(F.lit("notes.md"))) is None
    assert one(spark, urls.risk_number(F.lit("x A3 – Injection"))) == "A03"
    assert one(spark, urls.risk_label_title(F.lit("x A3 – Injection"))) == "Injection"
    assert one(spark, urls.risk_number(F.lit("none"))) is None
    assert one(spark, keys.content_hash(["id"])) == one(spark, keys.content_hash(["id"]))


def test_no_python_in_scalar_rules(spark):
    df = spark.createDataFrame([("a", "b")], "t string, u string").select(
        text.clean_description(F.col("t")), classify.category_of(F.col("t"), F.col("u")),
        text.recommendations(F.col("t")), urls.resolve_url(F.col("t"), F.col("u")),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
