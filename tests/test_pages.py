"""Golden tests of the page pipelines on own HTML."""

import pytest
from pyspark.sql import functions as F

import pyarrow as pa

from beaconry.functions import fixed_values
from beaconry.operators import links as lk
from beaconry.operators import sections as sec
from beaconry.plans import index, numbered, sheets
from beaconry.sources import html_elements
from beaconry.sources.html_elements import element_table, parse_elements
from beaconry.sources.pages import explode_crawl, normalise_pages, successful
from tests import fixtures
from tests.conftest import rows


def pages_of(spark, *htmls, url="https://g.example.org/page"):
    data = [(n, f"{url}{n}", h) for n, h in enumerate(htmls)]
    return spark.createDataFrame(data, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def sheet(spark):
    pages = pages_of(spark, fixtures.SHEET)
    elements = element_table(pages, cluster=True)
    return sheets.parse_sheets(elements, pages).first()


def texts(html, tag):
    return [r["text"] for r in parse_elements(html) if r["tag"] == tag]


def test_text_is_glued_and_stripped():
    assert texts("<p>x&amp &#65; &lt;&copy</p>", "p") == ["x&amp A <&copy"]
    assert texts("<p> a <b> b </b>\n c&amp;d </p>", "p") == ["abc&d"]


def test_paragraphs_end_each_other():
    parsed = parse_elements("<p>one<p>two<div><p>x</p></div>")
    assert [(r["tag"], r["parent"], r["text"]) for r in parsed] == [
        ("p", None, "one"), ("p", None, "two"), ("div", None, "x"), ("p", 2, "x"),
    ]


def test_without_implied_ends():
    parsed = parse_elements("<p>a<p>b</p><div>c</p>d", None, implied_ends=False)
    assert [(r["tag"], r["parent"], r["text"]) for r in parsed] == [
        ("p", None, "abc"), ("p", 0, "b"), ("div", 0, "c"),
    ]


def test_containers_have_text_after_a_heading():
    parsed = parse_elements("<section>a</section><h2>t</h2><section>b<table><tr><td>c</table></section>")
    assert [(r["tag"], r["text"]) for r in parsed if r["tag"] != "h2"] == [
        ("section", None), ("section", "bc"), ("table", None), ("tr", None), ("td", "c"),
    ]


def test_scripts_comments_and_attributes():
    html = """<div id='a' CLASS="x&amp;y" hidden data-n=3><!-- <p>no</p> --><script>var t="</p><p>";</script>z</div>"""
    parsed = parse_elements(html)
    assert [r["tag"] for r in parsed] == ["div", "script"]
    assert dict(parsed[0]["attrs"]) == {"id": "a", "class": "x&y", "hidden": "", "data-n": "3"}
    assert parsed[0]["text"] == "z"


def test_raw_and_single_text():
    parsed = parse_elements("<pre> a\n </pre><h2><b>Only</b></h2><h2>Two <i>x</i></h2>")
    by_tag = [(r["tag"], r["raw"], r["single"]) for r in parsed if r["tag"] in ("pre", "h2")]
    assert by_tag == [("pre", " a\n ", " a\n "), ("h2", "Only", "Only"), ("h2", "Two x", None)]


def test_stray_ends_and_open_quotes_do_not_break():
    assert texts("</p></div><p>a</b>b</p><a href=\"x>t</a><p>z", "p") == ["ab", "z"]
    assert parse_elements("") == [] and parse_elements(None) == []
    assert texts("<li>a</div>b<li>c", "li") == ["ab", "c"]


def test_sheet_fields(sheet):
    assert (sheet.title, sheet.id) == ("Token Handling", "token-handling")
    assert sheet.introduction == "Tokens provewhocalls. Keep them short lived."
    assert sheet.category == "Web Security" and sheet.icon == "📋"
    assert sheet.tags == ["Web Security", "tokens", "sessions", "token", "handling"]
    assert sheet.contributors == ["Ada", "BoB"]
    assert sheet.related_cheatsheets == ["other", "access-control"]


def test_sheet_sections(sheet):
    assert [s.title for s in sheet.sections] == [
        "Introduction", "Injection Attack", "Plain notes", "Nested", "Contributors",
    ]
    attack = sheet.sections[1]
    assert attack.content == (
        "Attackers send severe payloads and exploit the parser in many different ways.\n\nDeep text."
    )
    assert attack.warnings == ["Warning: never trust input."]
    assert attack.tips == ["Tip: validate early."]
    assert attack.code_examples == ["  select 1;  "]
    assert [(s.title, s.content) for s in attack.subsections] == [("Details", "Deep text.\n\nonetwo")]
    assert sheet.sections[2].content == "Nothing here.Nestedinner\n\nAfter nested."
    assert sheet.sections[3].content == "inner"


def test_sheet_risks_and_examples(sheet):
    risk = sheet.risks[0]
    assert [r.id for r in sheet.risks] == ["TOKEN-02"]
    assert (risk.title, risk.severity, risk.icon) == ("Injection Attack", "Critical", "🔴")
    assert risk.examples == ["  select 1;  "]
    example = sheet.attack_examples[0]
    assert (example.risk_id, example.title) == ("TOKEN-02", "Injection Attack")
    assert example.attack_prompt == "  select 1;  "


def test_sheet_without_sections_or_risks(spark):
    pages = pages_of(spark, fixtures.PLAIN, "<h1>Quiet page</h1><h2>Hello</h2><p>Nothing of note is said here.</p>")
    found = {r.page_id: r for r in sheets.parse_sheets(element_table(pages, cluster=True), pages).collect()}
    assert found[0].title == "Unknown" and found[0].sections == [] and found[0].risks == []
    assert found[0].introduction == "first second third"
    risk = found[1].risks[0]
    assert (risk.id, risk.title, risk.severity, risk.icon) == ("QUIET-01", "Quiet page", "Medium", "⚠️")
    assert found[1].attack_examples[0].title == "Quiet page Attack Scenario"
    assert found[1].attack_examples[0].impact == fixed_values.SCENARIO_IMPACT


def test_introduction_rules(spark):
    marked = sec.sibling_marks(element_table(pages_of(spark, fixtures.LINKING_HEADING), cluster=True))
    assert rows(sec.introductions(marked)) == [(0, "chosen a")]


def test_section_tree(spark):
    marked = sec.sibling_marks(element_table(pages_of(spark, fixtures.SHEET), cluster=True))
    tree = sec.section_tree(sec.sections(marked)).filter("level = 3")
    assert rows(tree, "parent_no", "section_no", "title") == [(2, 1, "Details")]


def test_build_index(spark):
    elements = element_table(pages_of(spark, fixtures.INDEX), cluster=True)
    base = "https://g.example.org"
    found = index.build_index(elements, base)
    assert [(r.id, r.title, r.url, r.category, r.languages) for r in found.collect()] == [
        ("sql", "SQL", f"{base}/cheatsheets/SQL_Cheat_Sheet.html", "Sql", "Go, Rust"),
        ("zeta-auth", "Zeta Auth", f"{base}/cheatsheets/Zeta_Auth_Cheat_Sheet.html", "Authentication", None),
    ]
    summary = index.index_summary(index.index_entries(elements, base), ["page_id"]).first()
    assert (summary.total_count, summary.categories) == (2, ["Api", "Authentication", "Sql"])
    loose = index.build_index_loose(elements, base + "/")
    assert rows(loose, "id") == [("sql",), ("zeta-auth",)]


def test_index_languages_use_the_page_without_article(spark):
    html = "<p><a href='cheatsheets/A_Cheat_Sheet.html'>A</a><img alt='C'></p>"
    found = lk.languages_by_url(element_table(pages_of(spark, html)), F.lit("https://g/"))
    assert rows(found, "url", "languages") == [("https://g/cheatsheets/A_Cheat_Sheet.html", "C")]


def test_risks_from_markdown(spark):
    source = spark.createDataFrame([("s", fixtures.NUMBERED_MARKDOWN)], "source_id string, markdown string")
    found = numbered.risks_from_markdown(source).orderBy("risk_no").collect()
    assert [(r.risk_id, r.title, r.description) for r in found] == [
        ("A01", "2025 - Again", "New text."), ("A2", "Second", "Only line."),
    ]
    assert found[0].examples == ["demo one"] and found[0].types == [("kind", "")]
    assert found[0].mitigations == [] and found[0].severity == "Medium"


def test_risk_page_markdown(spark):
    page = spark.createDataFrame([(1, fixtures.RISK_MARKDOWN)], "page_id bigint, markdown string")
    row = numbered.risk_page_markdown(page, ["page_id"]).first()
    assert row.description == "What it is."
    assert row.impacts == ["loss", "fame"]
    assert row.mitigations == ["patch"] and row.examples == ["someone tries"] and row.types == []


def test_risk_page_html(spark):
    elements = element_table(pages_of(spark, fixtures.RISK_HTML), cluster=True)
    row = numbered.risk_page_html(elements).first()
    assert row.description == "Lead text."
    assert row.impacts == ["later loss"] and row.mitigations == ["patchnow"]


def test_risk_links_and_headings(spark):
    links = numbered.risk_links(element_table(pages_of(spark, fixtures.TOP_LINKS)), "https://top.example")
    assert rows(links, "risk_id", "title", "url") == [
        ("A01", "Open Doors", "https://other.example/Top10/2025/A01_2025-Open_Doors/"),
        ("A02", "Weaker keys", "https://top.example/Top10/2025/A02_2025-Weak_Keys/"),
    ]
    heads = numbered.risk_headings(element_table(pages_of(spark, fixtures.HEADINGS), cluster=True))
    assert rows(heads, "risk_id", "title", "description") == [
        ("A01", "Open doors again", ""), ("A02", "Weak keys", ""),
    ]


def test_risks_of_sources_falls_back_per_source(spark):
    detail_url = "https://top.example/Top10/2025/A02_2025-Weak_Keys/"
    listing = "<ul><li>A03: Listed</li><li>A3 - Again</li></ul>"
    scraped = spark.createDataFrame(
        [
            (1, "u1", True, "", fixtures.NUMBERED_MARKDOWN),
            (2, "u2", True, fixtures.TOP_LINKS, None),
            (3, "u3", True, fixtures.HEADINGS, ""),
            (4, "u4", True, listing, ""),
            (5, "u5", False, listing, ""),
        ],
        "page_id bigint, url string, success boolean, html string, markdown string",
    )
    details = spark.createDataFrame(
        [(20, detail_url, True, fixtures.RISK_HTML, ""), (21, "x", True, "", "")],
        scraped.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " "),
    )
    found = numbered.risks_of_sources(
        scraped,
        element_table(scraped, implied_ends=False),
        details,
        element_table(details, implied_ends=False),
        "https://top.example",
    )
    assert rows(found, "source_id", "risk_id", "title", "description") == [
        ("1", "A01", "2025 - Again", "New text."),
        ("1", "A2", "Second", "Only line."),
        ("2", "A02", "Weaker keys", "Lead text."),
        ("3", "A01", "Open doors again", ""),
        ("3", "A02", "Weak keys", ""),
        ("4", "A03", "Listed", ""),
    ]


def test_crawl_and_scrape_records(spark):
    crawl = spark.sql(
        "SELECT 'j' job_id, array(named_struct('page_id', 2L, 'url', 'https://h/en/b.html'),"
        " named_struct('page_id', 1L, 'url', 'https://h/en/a'), named_struct('page_id', 3L, 'url', 'https://h/de/c')) pages"
    )
    assert rows(explode_crawl(crawl, "^/en", "html$"), "page_id") == [(1,)]
    jobs = spark.range(3).selectExpr(
        "concat('j', id) AS job_id", "transform(sequence(1, 60), n -> named_struct('page_id', id * 100 + n, 'url', 'https://h/a')) AS pages"
    )
    assert rows(explode_crawl(jobs).groupBy("job_id").count()) == [("j0", 50), ("j1", 50), ("j2", 50)]
    assert explode_crawl(jobs, max_pages=None).count() == 180
    records = spark.createDataFrame(
        [(1, "u", True, "<p>"), (2, "u", False, "<p>"), (3, "u", True, "")],
        "page_id bigint, url string, success boolean, html string",
    )
    assert rows(successful(normalise_pages(records)), "page_id") == [(1,)]


def test_every_element_table_is_parsed_once(spark, monkeypatch):
    """One pass over each element table feeds all levels, whatever tables are written on the way."""
    plans, real = [], numbered.materialise

    def kept_plan(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(numbered, "materialise", kept_plan)
    scraped = pages_of(spark, fixtures.HEADINGS).selectExpr("*", "true AS success", "'' AS markdown")
    found = numbered.risks_of_sources(
        scraped, element_table(scraped, implied_ends=False), scraped, element_table(scraped, implied_ends=False), "https://t"
    )
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert [p.count("ArrowEvalPython") for p in plans] == [1, 0, 1]


def test_element_numbers_hold_descendants_at_any_depth(spark):
    depth = 20_000
    pages = pages_of(spark, "<div>" * depth + "<p>x</p>" + "</div>" * depth + "<b>y</b>", fixtures.SHEET)
    table = element_table(pages)
    assert "ancestors" not in table.columns
    deep = table.filter("page_id = 0").select("pos", "last", "parent", "parent_last", "tag").collect()
    assert [(r.pos, r.last) for r in deep[:depth]] == [(n, depth) for n in range(depth)]
    assert deep[depth + 1][:] == (depth + 1, depth + 1, None, None, "b")
    rest = {r.pos: r for r in table.filter("page_id = 1").collect()}
    for r in rest.values():
        up = r.parent
        while up is not None:
            assert rest[up].pos < r.pos <= rest[up].last
            up = rest[up].parent
        assert r.parent is None or rest[r.parent].last == r.parent_last


def test_risk_page_lists_may_lie_in_each_other(spark):
    html = "<h2>Impact</h2><ul><li>a<div><h3>How to fix</h3><ul><li>b</li></ul></div></li></ul><h2>Impact</h2><ul><li>c</li></ul>"
    row = numbered.risk_page_html(element_table(pages_of(spark, html))).first()
    assert (row.impacts, row.mitigations, row.description) == (["c"], ["b"], "")
    nested = numbered.risk_page_html(element_table(pages_of(spark, html[: html.rindex("<h2>")]))).first()
    assert (nested.impacts, nested.mitigations) == (["aHow to fixb", "b"], ["b"])


def test_elected_keeps_the_least_level(spark):
    rows_in = [("s", 3, "x"), ("s", 1, "a"), ("s", 1, "b"), ("t", 4, "y"), (None, 2, "n"), (None, 0, "m")]
    frame = spark.createDataFrame(rows_in, "source_id string, level int, title string")
    found = sorted(tuple(r) for r in numbered.elected(frame.fillna("none")).collect())
    assert found == [("none", "m"), ("s", "a"), ("s", "b"), ("t", "y")]


def test_elements_leave_a_batch_a_few_pages_at_a_time(monkeypatch):
    monkeypatch.setattr(html_elements, "SLICE_CHARS", 30)
    sources = ["<p>one</p>" * 2, "", None, "<a href='x'>two</a><br>", "text", "<h1><b>three</b></h1>" * 5]
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array([7, 8, 9, None, 11, 12]), "html": pa.array(sources)})
    got = list(html_elements.element_batches([batch, batch.slice(0, 0)], None))
    want = [{"page_id": key, **row, "parent_last": row["parent_last"]} for key, page in zip([7, 8, 9, None, 11, 12], sources) for row in parse_elements(page)]
    assert [r for part in got for r in part.to_pylist()] == want
    assert len(got) > 1 and max(part.num_rows for part in got) < len(want)
