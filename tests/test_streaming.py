"""Streams give the batch result, also when the input comes in several batches."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from beaconry.operators.replay import cache_hits
from beaconry.sources import schemas
from beaconry.streaming import jobs
from tests.conftest import rows
from tests.test_operators import skewed_requests
from workload import stream_queries

DAY = "2024-01-01 00:00:00"


def test_stream_hits_equal_batch(spark, tmp_path):
    requests = spark.createDataFrame(skewed_requests(9), "k string, t bigint, id bigint").withColumn(
        "ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)
    )
    source = str(tmp_path / "in")
    parts = [requests.filter(f"t >= {low} and t < {low + 1_000}") for low in range(0, 5_000, 1_000)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    hits = jobs.stream_cache_hits(stream, ["k"], "ts", "id", 300_000_000)
    run = (
        hits.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    batch = cache_hits(requests.withColumn("us", F.unix_micros("ts")), ["k"], "us", "id", 300_000_000)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "miss") == rows(batch, "id", "miss")


def test_keys_of_one_bucket_stay_apart(spark, tmp_path):
    big = 2**53 + 1
    requests = spark.createDataFrame(
        [(k, e, t, big + 10 * t + n) for t in (0, 100, 200, 400) for n, (k, e) in enumerate([(big, "a"), (big + 1, "a"), (None, "a"), (big, None), (1, "")])],
        "k bigint, e string, t bigint, id bigint",
    ).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    source = str(tmp_path / "in")
    for low in (0, 200):
        requests.filter(f"t >= {low} and t < {low + 201}").filter(f"t < 200 or {low} > 0").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    hits = jobs.stream_cache_hits(stream, ["k", "e"], "ts", "id", 150_000_000, buckets=2)
    hits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    batch = cache_hits(requests.withColumn("us", F.unix_micros("ts")), ["k", "e"], "us", "id", 150_000_000)
    key = F.to_json(F.struct("k", "e")).alias("key")
    found = spark.read.parquet(str(tmp_path / "out"))
    assert rows(found, key, "id", "miss") == rows(batch, key, "id", "miss")


def test_ingest_batches_and_retry(spark, tmp_path):
    source = str(tmp_path / "pages")
    pages = [
        (1, "u1", "<h1>One</h1>", None), (2, "u2", "<title>Two</title>", 2e9), (3, "u3", "", None),
        (4, "u1", "<h1>One again</h1>", None), (5, "u2", "<title>Older</title>", 1.9e9),
    ]
    schema = "page_id bigint, url string, html string, scraped_at double"
    for page in pages:
        spark.createDataFrame([page], schema).coalesce(1).write.mode("append").parquet(source)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.ingest_pages(stream, target, checkpoint, DAY).awaitTermination()
    sheet = F.from_json("payload", f"{schemas.SHEET}")
    got = jobs.ingested(spark, target).select("identifier", sheet["id"].alias("id"), sheet["title"].alias("title"), F.size(sheet["tags"]).alias("tags"))
    # Of equally old versions the one of the later batch stays; an older page replaces nothing.
    assert rows(got) == [("u1", "one-again", "One again", 1), ("u2", "two", "Two", 1)]


def versions(spark, seed):
    """Versions of 25 pages with distinct times in random order; many repeat the content before them."""
    rng = random.Random(seed)
    found = [
        (100 * n + v, f"https://h/{n}", f"<h1>Page {n}</h1><h2>Attack</h2><p>content {rng.randrange(3)}</p>", float(1_000_000 + 10 * v))
        for n in range(25) for v in range(6)
    ]
    rng.shuffle(found)
    return found


def test_ingest_of_shuffled_versions_equals_the_batch_of_the_newest(spark, tmp_path):
    schema = "page_id bigint, url string, html string, scraped_at double"
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    found = versions(spark, 4)
    # Three micro-batches, then a restart from the checkpoint with two more.
    for parts in ((0, 1, 2), (3, 4)):
        for k in parts:
            spark.createDataFrame(found[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.ingest_pages(stream, target, checkpoint, DAY).awaitTermination()
        newest = {}
        for row in found[: 30 * (parts[-1] + 1)]:
            newest[row[1]] = max(newest.get(row[1], row), row, key=lambda r: r[3])
        want = jobs.page_entries(spark.createDataFrame(list(newest.values()), schema), DAY)
        got = jobs.ingested(spark, target)
        assert rows(got, "identifier", "payload") == rows(want, "identifier", "payload")


def test_only_new_and_changed_contents_pass(spark, tmp_path):
    schema = "page_id bigint, url string, html string, scraped_at double"
    source = str(tmp_path / "in")
    batches = [
        [(1, "u", "a", 10.0), (2, "u", "b", 20.0), (3, "v", "x", 5.0)],
        [(4, "u", "old", 15.0), (5, "u", "b", 30.0), (6, "v", "x", 6.0), (7, None, "n", 1.0)],
        [(8, "u", "c", 29.0), (9, "v", "y", 6.0), (10, "u", "", 99.0), (11, None, "n", 1.0)],
    ]
    seen = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)

        def keep(frame, _):
            seen.append(sorted(r.page_id for r in frame.collect()))

        changed = jobs.changed_pages(stream, DAY)
        jobs.start_stateful(changed, keep, str(tmp_path / "cp")).awaitTermination()
    # An older version, the same content again and an empty page give nothing.
    assert seen == [[2, 3], [7], [9]]


def test_a_batch_works_through_the_state_once(spark, tmp_path):
    schema = "page_id bigint, url string, html string, scraped_at double"
    source = str(tmp_path / "in")
    for part in (0, 1):
        spark.createDataFrame(versions(spark, 4)[part * 75 : part * 75 + 75], schema).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def updates(run):
        run.awaitTermination()
        return [p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress if p["numInputRows"]]

    once = updates(jobs.start_stateful(jobs.changed_pages(stream(), DAY), lambda frame, _: frame.collect(), str(tmp_path / "cp1")))
    ingest = updates(jobs.ingest_pages(stream(), str(tmp_path / "out"), str(tmp_path / "cp2"), DAY))
    assert len(once) == 2 and ingest == once


def test_equal_versions_without_a_page_id(spark, tmp_path):
    schema = "page_id bigint, url string, html string, scraped_at double"
    found = [(None, "u", "a", 9.0), (3, "u", "a", 9.0), (2, "u", "a", 9.0), (None, None, "n", 1.0), (None, None, "n", 1.0), (7, "v", "x", 5.0), (8, "v", "", 6.0)]
    source = str(tmp_path / "in")
    # In one file the versions meet in one Arrow batch, in several they meet at the state.
    for name, parts in (("one", [found]), ("many", [[row] for row in found])):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}-{name}")
        seen = []
        changed = jobs.changed_pages(spark.readStream.schema(schema).parquet(f"{source}-{name}"), DAY)
        jobs.start_stateful(changed, lambda frame, _: seen.extend(frame.collect()), str(tmp_path / f"cp-{name}")).awaitTermination()
        assert sorted((r.url or "", r.page_id) for r in seen) == [("", None), ("u", 3), ("v", 7)]


def test_newest_versions_of_an_arrow_batch():
    def kept(table):
        batches = list(jobs.newest_versions(iter([pa.RecordBatch.from_pydict(table, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("fetched", pa.int64()), ("content_hash", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))]))])))
        assert len(batches) == 1
        return sorted(batches[0].column("page_id").to_pylist())

    table = {
        "page_id": [1, 2, 3, 4, 5, 6, 7], "url": ["u", "v", "u", None, "v", None, "w"], "fetched": [5, 1, 4, 2, 1, 1, 0],
        "content_hash": ["a", "b", "c", "d", "a", "e", "f"], "metadata": [[("k", "x")], None, [], None, None, None, None],
    }
    assert kept(table) == [1, 2, 4, 7]
    assert kept({name: [] for name in table}) == []


def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path):
    table = spark.createDataFrame([(n, f"https://h/{n}", f"<h1>Page {n}</h1>") for n in range(9)], "page_id bigint, url string, html string")
    folder, single = tmp_path / "folder", tmp_path / "single"
    table.repartition(3).write.parquet(str(folder / "pages.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    single.mkdir()
    next((tmp_path / "one").glob("part-*")).rename(single / "pages.parquet")
    for sf in (folder, single):
        found = stream_queries.stream_ingest(spark, str(sf))
        assert rows(found, "identifier", "title") == [(f"https://h/{n}", f"Page {n}") for n in range(9)]
    newest = stream_queries.stream_versions(spark, str(folder))
    assert rows(newest, "identifier", "title") == [(f"https://h/{n}", f"V{(5 - n % 3) % 3} Page {n}") for n in range(9)]
