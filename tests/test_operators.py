"""Order-dependent operators against plain-Python twins on random input."""

import random

import pytest
from pyspark.sql import functions as F

from beaconry.functions import text
from beaconry.operators import lines as ln
from beaconry.operators import replay, running, snapshots
from beaconry.operators.firsts import first_match, first_per_key, last_per_key, top_per_key
from beaconry.plans import metrics
from tests.conftest import rows


def skewed_requests(seed, count=600, hot_share=0.5):
    """Requests of few keys, one of them hot, with repeated times."""
    rng = random.Random(seed)
    out = []
    for n in range(count):
        key = "hot" if rng.random() < hot_share else rng.choice("abcd")
        out.append((key, rng.randrange(0, 5_000), n))
    return out


def misses(requests, ttl):
    found, expiry = set(), {}
    for key, at, n in sorted(requests, key=lambda r: (r[1], r[2])):
        if key not in expiry or at > expiry[key]:
            found.add(n)
            expiry[key] = at + ttl
    return found


@pytest.mark.parametrize("split_keys", [False, True])
@pytest.mark.parametrize("ttl", [64, 640])
def test_cache_hits(spark, split_keys, ttl):
    requests = skewed_requests(ttl)
    df = spark.createDataFrame(requests, "k string, t bigint, id bigint").repartition(5)
    got = replay.cache_hits(df, ["k"], "t", "id", ttl, split_keys)
    flags = {r.id: r.miss for r in got.collect()}
    assert len(flags) == len(requests)
    assert {n for n, miss in flags.items() if miss} == misses(requests, ttl)


@pytest.mark.parametrize("split_keys", [False, True])
def test_cache_hits_with_nulls_and_repeats(spark, split_keys):
    data = [("a", 5, 1), ("a", 5, 1), ("a", None, 2), ("a", 5, 3), (None, 5, 4), (None, 14, 5), (None, 16, 6), ("a", 16, 7)]
    df = spark.createDataFrame(data, "k string, t bigint, id bigint")
    got = sorted((r.id, r.miss) for r in replay.cache_hits(df, ["k"], "t", "id", 10, split_keys).collect())
    assert got == [(1, False), (1, True), (2, False), (3, False), (4, True), (5, False), (6, True), (7, True)]


def test_upsert_prefers_the_fresh_entry(spark):
    schema = "identifier string, created_at bigint, content_hash string"
    stored = spark.createDataFrame([("a", 1, "z"), ("b", 5, "y"), ("c", 1, "x")], schema)
    fresh = spark.createDataFrame([("a", 1, "b"), ("b", 4, "z"), ("d", 1, "p"), ("d", 1, "q")], schema)
    assert rows(snapshots.upsert(stored, fresh)) == [("a", 1, "b"), ("b", 5, "y"), ("c", 1, "x"), ("d", 1, "q")]


@pytest.mark.parametrize("chunk", [1, 700, 10_000])
def test_pace_requests(spark, chunk):
    requests = skewed_requests(5)
    want, last = {}, {}
    for key, at, n in sorted(requests, key=lambda r: (r[1], r[2])):
        want[n] = max(at, last[key] + 40) if key in last else at
        last[key] = want[n]
    df = spark.createDataFrame(requests, "k string, t bigint, id bigint")
    got = running.pace_requests(df, "k", "t", "id", 40, chunk)
    assert {r.id: r.start_us for r in got.collect()} == want
    assert running.pacing_interval_us(30) == 2_000_000


def test_ordinal_equals_plain_count(spark):
    data = [("hot" if n % 3 else "cold", n) for n in range(500)]
    df = spark.createDataFrame(data, "k string, n bigint")
    got = running.ordinal(df, ["k"], ["n"], F.floor(F.col("n") / 37))
    counts, want = {}, set()
    for key, n in data:
        counts[key] = counts.get(key, 0) + 1
        want.add((key, n, counts[key]))
    assert set(rows(got)) == want


@pytest.mark.parametrize("limit", [0, 100, 1_500, 4_000, 10**6])
def test_evict_equals_loop(spark, limit):
    rng = random.Random(limit)
    data = [
        (f"id{n}", f"{rng.getrandbits(64):016x}", f"2024-01-0{rng.randrange(1, 4)} 00:00:{rng.randrange(3):02d}", rng.randrange(100))
        for n in range(100)
    ]
    total = sum(d[3] for d in data)
    want = set()
    if total > limit:
        for name, _, _, size in sorted(data, key=lambda d: (d[2], d[1])):
            if total <= limit * 0.8:
                break
            total -= size
            want.add(name)
    snap = spark.createDataFrame(data, "identifier string, key string, expires string, size_bytes bigint")
    snap = snap.withColumn("expires_at", F.col("expires").cast("timestamp"))
    assert {r.identifier for r in snapshots.evicted(snap, limit).collect()} == want
    kept = snapshots.evict(snap, limit)
    assert kept.count() == len(data) - len(want)


@pytest.mark.parametrize("most_rows", [1, 50, 10_000])
def test_evict_inside_one_expiry_time(spark, most_rows):
    """Only a bounded cell reaches the one task that sorts, even if all rows expire together."""
    rng = random.Random(3)
    data = [(f"id{n}", f"{rng.getrandbits(128):032x}"[: 32 if n % 9 else 3] or "0", rng.randrange(100)) for n in range(3_000)]
    data += [(f"same{n}", "f" * 32, 5) for n in range(40)]
    snap = spark.createDataFrame(data, "identifier string, key string, size_bytes bigint").withColumn(
        "expires_at", F.lit("2024-01-01").cast("timestamp")
    )
    levels = [F.col("expires_at").cast("string"), *[F.substring("key", 1, n) for n in (1, 2, 4, 32)]]
    total = sum(d[2] for d in data)
    for need in (0.5, 777, total / 2, total - 150, total + 1):
        want, before = set(), 0
        for name, key, size in sorted(data, key=lambda d: (d[1], d[0])):
            if before < need:
                want.add(name)
            before += size
        got = {r.identifier for r in running.cumulative_cut(snap, "size_bytes", levels, ["key", "identifier"], need, most_rows).collect()}
        ties = {n for n, key, _ in data if key == "f" * 32} if most_rows == 1 and need == total - 150 else set()
        assert got == want | ties


TRIGGERS = ["impact", "effect"]
PARTS = ["Impact list:", "the effect is", "- a longer bullet item", "* short", "12) numbered item here",
         "# heading", "", "  ", "plain words", "• dotted bullet entry", "3. third numbered entry", "- impact bullet again"]


def listed(content):
    found, on = [], False
    for line in content.split("\n"):
        bare = line.strip()
        if any(t in bare.lower() for t in TRIGGERS):
            on = True
        elif on:
            head = bare.split(" ")[0]
            bullet = head in ("-", "*", "•") or (head[:-1].isdigit() and head[-1] in ".)") if head else False
            if bullet and " " in bare:
                item = bare.lstrip("-*•0123456789.)").lstrip()
                if len(item) > 10:
                    found.append(item)
            elif bare == "" or bare.startswith("#"):
                on = False
    return found


def test_list_items_equal_loop(spark):
    rng = random.Random(3)
    docs = [(n, "\n".join(rng.choices(PARTS, k=rng.randrange(1, 25)))) for n in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = ln.list_item_rows(ln.line_table(df, ["doc_id"], "text"), ["doc_id"], TRIGGERS)
    got = {}
    for r in found.orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.item)
    folded = df.select("doc_id", text.list_items(F.col("text"), TRIGGERS, 5).alias("items"))
    capped = {r.doc_id: r["items"] for r in folded.collect()}
    for n, content in docs:
        assert got.get(n, []) == listed(content)
        assert capped[n] == listed(content)[:5]


def test_bucket_rows_equal_loop(spark):
    rng = random.Random(4)
    parts = ["Impact", "mitigation steps", "Prevention", "### Impact", "- one", "2. two", "examples", "types", "text"]
    docs = [(n, "\n".join(rng.choices(parts, k=15))) for n in range(100)]
    names = {"impact": "impacts", "mitigation": "mitigations", "prevention": "mitigations",
             "example": "examples", "type": "types", "categories": "types"}
    want = []
    for n, content in docs:
        bucket = None
        for pos, line in enumerate(content.split("\n")):
            opened = next((b for p, b in names.items() if line.lower().startswith(p)), None)
            if opened:
                bucket = opened
            elif bucket:
                want.append((n, pos, bucket, line.split(" ", 1)[1] if line[0] in "-2" else line))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = ln.bucket_rows(ln.line_table(df, ["doc_id"], "text"), ["doc_id"])
    assert rows(got) == sorted(want)


def test_firsts_and_top(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert rows(first_per_key(df, ["k"], ["n"])) == [("a", 1, "y"), ("b", 3, "z")]
    assert rows(last_per_key(df, ["k"], ["n"])) == [("a", 2, "x"), ("b", 3, "z")]
    assert rows(top_per_key(df, ["k"], [F.col("n")], 1), "k", "n") == [("a", 1), ("b", 3)]
    assert first_match(df, F.col("k") == "b", ["n"]).first().v == "z"
    assert first_match(df, F.col("k") == "no", ["n"], v="none").first().v == "none"
    assert first_match(df, F.col("k") == "no", ["n"]).first().n == 1


def test_snapshot_rules(spark):
    entries = spark.sql("SELECT 'u' identifier, 'body' payload, timestamp'2024-01-01 00:00:00' created_at")
    old = snapshots.snapshot_rows(entries)
    new = snapshots.snapshot_rows(
        entries.withColumns({"payload": F.lit("changed"), "created_at": F.expr("timestamp'2024-02-01 00:00:00'")}), 7
    )
    merged = snapshots.upsert(old, new)
    assert rows(merged, "payload") == [("changed",)]
    edge = F.expr("timestamp'2024-02-08 00:00:00'")
    assert snapshots.read_valid(merged, edge).count() == 1
    late = edge + F.expr("interval 1 microsecond")
    assert snapshots.read_valid(merged, late).count() == 0
    assert snapshots.read_valid(merged, late, ignore_expiry=True).count() == 1
    assert snapshots.read_valid(merged, edge, enabled=False).count() == 0
    kept, dropped = snapshots.expire(merged, late)
    assert kept.count() == 0 and dropped.first().expired == 1
    assert rows(snapshots.content_changes(old, new), "identifier", "status") == [("u", "changed")]
    assert rows(snapshots.content_changes(old, old), "status") == [("same",)]
    assert rows(snapshots.content_changes(old, new.filter("false")), "status") == [("gone",)]
    assert rows(snapshots.content_changes(old.filter("false"), new), "status") == [("new",)]
    assert snapshots.clear(merged).count() == 0
    assert snapshots.stats(merged).first().entry_count == 1


def test_risk_detail_hints_and_duplicates(spark):
    risks = spark.sql(
        """SELECT 's' sheet_id, n risk_no, 'R1' risk_id, 'T' title, array(named_struct('name', 'a', 'descr', 'b')) types,
        array(concat('i', n)) impacts, cast(array() AS array<string>) mitigations, cast(array() AS array<string>) examples FROM (SELECT explode(array(1, 2)) n)"""
    )
    got = rows(metrics.risk_detail(risks, "R1: T"), "kind", "text", "descr")
    assert ("impacts", "i2", None) in got and ("types", "a", "b") in got and len(got) == 4
    assert any(k == "examples" and "code examples" in t for k, t, _ in got)


def test_highest_level(spark):
    got = spark.range(1).select(
        metrics.highest_level(F.array(F.lit("low"), F.lit("high"))).alias("a"),
        metrics.highest_level(F.array().cast("array<string>")).alias("b"),
    ).first()
    assert (got.a, got.b) == ("high", None)
