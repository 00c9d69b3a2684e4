"""Headline timings: one JSON line for the tables in ``$BENCH_SF_DIR``.

Every query runs once to warm up, then once timed into a ``noop`` sink, so the
whole result is computed and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from beaconry.session import build_session
from workload import QUERIES

HEADLINE = [
    "category_index", "element_counts", "resolve_url", "build_index", "introductions",
    "heading_sections", "sheet_titles", "parse_sheets",
    "clean_title", "slugify", "category_of", "assess_severity", "clean_description",
    "recommendations", "title_tags", "rule_scan", "risk_ids",
    "list_items", "bucket_lines", "header_buckets", "collect_by_keys", "risks_from_markdown",
    "section_risks", "section_attacks",
    "examples_with_risk", "cache_misses_lookup", "coverage_grid", "risk_cards",
    "guidance_context", "top_lines_per_order", "first_order_per_customer", "highest_risk",
    "snapshot_upsert", "snapshot_evict", "content_changes", "pace_requests", "cache_hits",
    "content_parts", "guardrail_fix", "render_report", "parse_reports",
    "stream_cache_hits", "stream_ingest",
    "crawl_jobs", "detail_per_host", "report_table", "json_round_trip",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - started
    spark.catalog.clearCache()
    return took


def growth(spark, timings: dict[str, float], sf_dir: str, small: str, count: int = 10) -> dict[str, float]:
    """Time at ``sf_dir`` over time at the smaller scale, for the slowest queries."""
    slowest = sorted(timings, key=timings.get, reverse=True)[:count]
    before = {}
    for name in slowest:
        run(spark, name, small)
        before[name] = run(spark, name, small)
    return {name: round(timings[name] / before[name], 2) for name in slowest}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        run(spark, name, sf_dir)
        timings[name] = round(run(spark, name, sf_dir), 3)
    small = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    ratios = growth(spark, timings, sf_dir, small) if os.path.isdir(small) else {}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of warm runs",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "growth": ratios,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
