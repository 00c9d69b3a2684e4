"""Joins, aggregations, risk views and top-k over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import fixed_values as fixed
from beaconry.functions.keys import expires_at
from beaconry.operators.firsts import first_per_key, last_per_key, top_per_key
from beaconry.operators.snapshots import cache_lookup
from beaconry.plans import metrics, numbered, sheets
from workload.registry import query, table
from workload.text_queries import SQL_FIRST, first_line

SQL_RISKS = f"""
    SELECT source AS sheet_id, doc_id AS risk_no, 'D' || doc_id AS risk_id, {SQL_FIRST} AS title, lang AS severity, '*' AS icon, text AS description,
        string_split({SQL_FIRST}, ' ') AS impacts, list_filter(string_split(text, chr(10)), lambda l: length(l) > 200) AS mitigations FROM documents
"""


def _risks(spark, sf):
    """Documents in the shape of risk rows: sources are sheets, lines are mitigations."""
    none = F.array().cast("array<string>")
    pair = F.struct(F.col("lang").alias("name"), F.col("source").alias("descr"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("sheet_id"),
        F.col("doc_id").alias("risk_no"),
        F.concat(F.lit("D"), "doc_id").alias("risk_id"),
        first_line().alias("title"),
        F.col("lang").alias("severity"),
        F.lit("*").alias("icon"),
        F.col("text").alias("description"),
        F.array(pair).alias("types"),
        F.split(first_line(), " ").alias("impacts"),
        F.filter(F.split("text", "\n"), lambda line: F.length(line) > 200).alias("mitigations"),
        none.alias("examples"),
    )


@query(
    "examples_with_risk",
    """
    SELECT doc_id, coalesce(q, 'Medium') AS severity, coalesce(t, '⚠️') AS icon FROM documents
    LEFT JOIN (SELECT doc_id, CASE min(quality) WHEN 1 THEN 'Low' ELSE 'High' END AS q, cast(min(toxic) AS VARCHAR) AS t FROM labels GROUP BY 1) USING (doc_id)
    """,
)
def examples_with_risk(spark, sf):
    examples = table(spark, sf, "documents").select(
        F.lit(0).alias("sheet_id"), F.col("doc_id").alias("risk_id"), "doc_id"
    )
    risks = table(spark, sf, "labels").select(
        F.lit(0).alias("sheet_id"),
        F.col("doc_id").alias("risk_id"),
        F.struct("quality", "toxic").alias("risk_no"),
        F.when(F.col("quality") == 1, "Low").otherwise("High").alias("severity"),
        F.col("toxic").cast("string").alias("icon"),
    )
    return metrics.examples_with_risk(examples, risks).select("doc_id", "severity", "icon")


@query(
    "examples_inner_risk",
    "SELECT conv_id, turn, quality FROM conversations JOIN labels ON conv_id = doc_id",
)
def examples_inner_risk(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "conv_id")
    turns = table(spark, sf, "conversations")
    return metrics.examples_inner_risk(turns, labels, ["conv_id"])[0].select("conv_id", "turn", "quality")


@query(
    "examples_without_risk",
    "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)",
)
def examples_without_risk(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "conv_id")
    turns = table(spark, sf, "conversations")
    return metrics.examples_inner_risk(turns, labels, ["conv_id"])[1].select("conv_id", "turn")


TERMS = ["ation", "ment", "ung", "ción", "ble"]


@query(
    "section_to_risk",
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN contains(lower({SQL_FIRST}), '{t}') THEN '{t}'" for t in TERMS)
    + f" ELSE '{TERMS[0]}' END AS risk FROM documents",
)
def section_to_risk(spark, sf):
    risks = F.array(*[F.struct(F.lit(t).alias("title")) for t in TERMS])
    chosen = sheets.first_named_risk(risks, first_line())["title"]
    return table(spark, sf, "documents").select("doc_id", chosen.alias("risk"))


@query(
    "cache_hits_lookup",
    """
    SELECT o_orderkey AS identifier FROM orders WHERE o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1997-01-01'
        AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    """,
)
def cache_hits_lookup(spark, sf):
    return _lookup(spark, sf)[0].select("identifier")


@query(
    "cache_misses_lookup",
    """
    SELECT DISTINCT l_orderkey AS identifier FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN
        (SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1997-01-01')
    """,
)
def cache_misses_lookup(spark, sf):
    return _lookup(spark, sf)[1]


def _lookup(spark, sf):
    wanted = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("identifier")
    )
    stored = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("identifier"), expires_at(F.col("o_orderdate")).alias("expires_at")
    )
    return cache_lookup(wanted, stored, F.expr("timestamp_ntz'1997-01-01 00:00:00'"))


@query(
    "overview_metrics",
    """
    SELECT o_orderstatus, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS "n_1-urgent",
        count(*) FILTER (o_orderpriority = '2-HIGH') AS "n_2-high" FROM orders GROUP BY 1
    """,
)
def overview_metrics(spark, sf):
    return metrics.overview_metrics(
        table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], ["o_orderstatus"]
    )


@query(
    "turn_matrix",
    """
    SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant
    FROM conversations GROUP BY 1
    """,
)
def turn_matrix(spark, sf):
    turns = table(spark, sf, "conversations")
    return metrics.overview_metrics(turns, "role", ["user", "assistant"], ["conv_id"])


@query(
    "risk_matrix",
    f"""
    SELECT sheet_id, risk_id, title, severity, length(impacts) AS impact_count, length(mitigations) AS mitigation_count FROM ({SQL_RISKS})
    """,
)
def risk_matrix(spark, sf):
    matrix = metrics.risk_matrix(_risks(spark, sf))
    return matrix.withColumns({c: F.col(c).cast("bigint") for c in ("impact_count", "mitigation_count")})


@query(
    "highest_risk",
    """
    SELECT o_custkey, CASE min(CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 END)
        WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS highest FROM orders GROUP BY 1
    """,
)
def highest_risk(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.lower(F.substring("o_orderpriority", 3, 100)).alias("level")
    )
    return metrics.highest_per_key(orders, ["o_custkey"], "level", fixed.RISK_LEVELS)


@query(
    "guidance_context",
    """
    WITH t AS (SELECT conv_id, turn, role, string_split(text, chr(10))[1:3] AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
    SELECT conv_id AS sheet_id, 'Sheet: ' || conv_id || chr(10) || string_agg('- T' || turn || ': ' || role || ' (Severity: Medium)' ||
        array_to_string(list_transform(m, lambda x: chr(10) || '  - Mitigation: ' || x), ''), chr(10) ORDER BY r) AS context
    FROM t WHERE r <= 10 GROUP BY 1
    """,
)
def guidance_context(spark, sf):
    risks = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("sheet_id"),
        F.col("turn").alias("risk_no"),
        F.concat(F.lit("T"), "turn").alias("risk_id"),
        F.col("role").alias("title"),
        F.lit(None).cast("string").alias("severity"),
        F.split("text", "\n").alias("mitigations"),
    )
    return metrics.guidance_context(risks, F.array(F.concat(F.lit("Sheet: "), "sheet_id")))


GRID = ["click", "error", "purchase", "signup", "view"]


@query(
    "coverage_grid",
    f"""
    SELECT u.user_id, g.category, CASE coalesce(max(CASE WHEN e.value > 20 THEN 2 WHEN e.value > 5 THEN 1 ELSE 0 END), 0)
        WHEN 2 THEN 'confirmed' WHEN 1 THEN 'needs_attention' ELSE 'not_observed' END AS status, count(e.event_id) AS evidence_count
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest({GRID!r}) AS category) g
    LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = g.category GROUP BY 1, 2
    """,
)
def coverage_grid(spark, sf):
    value = F.col("value")
    rank = F.when(value > 20, 2).when(value > 5, 1).otherwise(0)
    return metrics.coverage_grid(table(spark, sf, "events"), "user_id", "event_type", rank, GRID)


@query(
    "risk_list",
    f"""
    SELECT risk_id, array_to_string(impacts[1:3], '|') AS impacts,
        CASE WHEN length(mitigations) = 0 THEN '{fixed.NO_MITIGATIONS}' ELSE array_to_string(mitigations[1:3], '|') END AS mitigations FROM ({SQL_RISKS})
    """,
)
def risk_list(spark, sf):
    shown = metrics.risk_list(_risks(spark, sf))
    return shown.select(
        "risk_id", F.concat_ws("|", "impacts").alias("impacts"),
        F.concat_ws("|", "mitigations").alias("mitigations"),
    )


@query(
    "risk_cards",
    f"""
    SELECT sheet_id, risk_no, '* ' || risk_id || ': ' || title AS label, '⚪ ' || severity AS severity,
        CASE WHEN length(description) > 150 THEN left(description, 150) || '...' ELSE description END AS description
    FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY risk_no) AS r FROM ({SQL_RISKS})) WHERE r <= 6
    """,
)
def risk_cards(spark, sf):
    return metrics.risk_cards(_risks(spark, sf))


@query(
    "risk_detail",
    f"""
    WITH r AS (SELECT * FROM ({SQL_RISKS}) WHERE risk_id || ': ' || title = (SELECT 'D' || doc_id || ': ' || {SQL_FIRST} FROM documents ORDER BY length(text) DESC, doc_id DESC LIMIT 1))
    SELECT 'types' AS kind, 1 AS item_no, severity AS text FROM r
    UNION ALL SELECT 'impacts', generate_subscripts(impacts, 1), unnest(impacts) FROM r
    UNION ALL SELECT 'mitigations', generate_subscripts(mitigations, 1), unnest(mitigations) FROM r
    UNION ALL SELECT 'examples', 1, '{fixed.DETAIL_HINTS["examples"]}' FROM r
    """,
)
def risk_detail(spark, sf):
    """Details of the risk with the longest text, picked by its label."""
    risks = _risks(spark, sf)
    size = F.struct(F.length("description"), "risk_no")
    longest = F.max_by(F.concat_ws(": ", "risk_id", "title"), size)
    label = risks.agg(longest.alias("label")).first()["label"]
    return metrics.risk_detail(risks, label).select(
        "kind", F.col("item_no").cast("bigint").alias("item_no"), "text"
    )


@query(
    "top_lines_per_order",
    """
    SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber,
        cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM lineitem) WHERE rank <= 6
    """,
)
def top_lines_per_order(spark, sf):
    order = [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"]
    lines = table(spark, sf, "lineitem").select(*columns)
    return top_per_key(lines, ["l_orderkey"], order, 6).select("l_orderkey", "l_linenumber", "rank")


@query(
    "top_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def top_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "cap_lists",
    "SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:5], ' ') AS five, array_to_string(string_split(text, ' ')[1:7], ' ') AS seven FROM conversations",
)
def cap_lists(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.array_join(F.slice(words, 1, 5), " ").alias("five"),
        F.array_join(F.slice(words, 1, 7), " ").alias("seven"),
    )


@query(
    "first_order_per_customer",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1
    """,
)
def first_order_per_customer(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "last_order_per_customer",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1
    """,
)
def last_order_per_customer(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return last_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "fallback_chain",
    """
    SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role,
        dense_rank() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END) AS r FROM conversations) WHERE r = 1
    """,
)
def fallback_chain(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    levels = [turns.filter(F.col("role") == role) for role in ("system", "assistant")]
    return numbered.fallback_chain(["conv_id"], *levels, turns)


@query(
    "union_matches",
    """
    SELECT DISTINCT m FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^\\pL])([A-Z][a-z]+tion)', 1)) AS m FROM documents
        UNION ALL SELECT unnest(regexp_extract_all(text, '(?:^|[^\\pL])(the[a-z]+ing)', 1)) FROM documents)
    """,
)
def union_matches(spark, sf):
    found = [
        F.regexp_extract_all("text", F.lit(p), F.lit(1))
        for p in (r"(?:^|[^\p{L}])([A-Z][a-z]+tion)", r"(?:^|[^\p{L}])(the[a-z]+ing)")
    ]
    docs = table(spark, sf, "documents")
    return docs.select(F.explode(F.concat(*found)).alias("m")).distinct()
