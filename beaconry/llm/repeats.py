"""Removal of long strings that stand anywhere else in the corpus, by sorted suffixes of shards.

1. Texts are cut into runs of windows with a common anchor (see ``anchors``); only anchors that occur more than once
   can hold repeats. Runs with equal bytes are counted before anything else moves, so a passage that a third of
   the corpus shares is one text with a weight; where an anchor has no other run, all its windows are repeated.
2. The bytes of each distinct run go to the shard of its anchor. A shard sorts the suffixes of its runs
   (see ``suffixes``); window starts whose neighbours share ``length`` bytes, with a weight of two or more
   together, are repeated. An anchor whose distinct runs are more than a shard may sort goes another way: all its
   windows are counted by a hash of 128 bits, so no task holds it.
3. Repeated starts return to all documents that have the run, become spans, and the spans are removed.

All matching is on the input; documents are never joined, so no match crosses them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.anchors import GRAM, Hashes, runs
from beaconry.llm.common import materialise, slices
from beaconry.llm.suffixes import suffix_order

LENGTH = 200
#: Bytes of text that a shard sorts at a time. One anchor's runs stay together, so it may be twice as much; an anchor
#: with more than this is not sorted.
SORT_BYTES = 1_500_000
#: Characters of the sorted text: its end, the end of a run, and the bytes.
CHARS = 258

RUNS_SCHEMA = "id long, hash long, begin int, windows int, anchor long, content long"
STARTS_SCHEMA = "anchor long, content long, first int, last int"
SIDES_SCHEMA = "anchor long, content long, n long, side int, a long, b long"
WINDOWS_SCHEMA = "anchor long, content long, n long, first int, a long, b long"
#: Runs whose windows are hashed at a time.
HASHED_RUNS = 2_000


def _keys(id_col: str, text: Column) -> tuple[Column, Column]:
    """Key of a row: its id, and a hash of the text that also tells null ids apart."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(text, F.col(id_col).isNull())


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, own = _keys("doc_id", text)
    return docs.select(key.alias("id"), text.alias("text"), own.alias("hash"), F.col("doc_id").cast("long").alias("doc_id"))


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            data = pa.array([press.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data, batch.column(2), batch.column(3)], ["id", "packed", "hash", "doc_id"])

    return _texts(docs).mapInArrow(pack, "id long, packed binary, hash long, doc_id long")


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def find(batches):
        for batch in slices(batches):
            row, begin, windows, anchor, content = runs([t.encode() for t in batch.column(1).to_pylist()], length)
            if len(row):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), pa.array(begin, pa.int32()), pa.array(windows, pa.int32()),
                     pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["id", "hash", "begin", "windows", "anchor", "content"],
                )

    return _texts(docs).select("id", "text", "hash").mapInArrow(find, RUNS_SCHEMA)


def _repeated_starts(pieces: list[bytes], weights: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Per run (its windows' bytes) the stretches of window starts that stand at least twice, by weight."""
    sizes = np.array([len(p) for p in pieces])
    # 16 bits per character: sorts of them are radix sorts.
    text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 2, 1) for p in pieces] + [np.zeros(1)]).astype(np.int16)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    order, common = suffix_order(text, CHARS, length)
    whole = np.zeros(len(text), bool)
    whole[:-1] = np.arange(len(owner)) - begins[owner] <= (sizes - length)[owner]
    head = np.flatnonzero(common < length)
    weight = np.where(whole[order], np.append(np.array(weights, np.int64)[owner], 0)[order], 0)
    total = np.repeat(np.add.reduceat(weight, head), np.diff(np.append(head, len(order))))
    repeated = np.zeros(len(text), bool)
    repeated[order[(total >= 2) & whole[order]]] = True
    out = []
    for begin, size in zip(begins, sizes):
        own = repeated[begin : begin + size].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
        out.append(list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())))
    return out


def _sort_shards(length: int):
    def sort(batches):
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None

        def done():
            found = _repeated_starts([h[3] for h in held], [h[2] for h in held], length)
            flat = [(h[0], h[1], a, b) for h, spans in zip(held, found) for a, b in spans]
            if flat:
                anchor, content, first, end = zip(*flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
                    ["anchor", "content", "first", "last"],
                )

        for batch in batches:
            for anchor, content, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if last == (anchor, content):
                    continue
                if size >= SORT_BYTES and anchor != last[0]:
                    yield from done()
                    held, size = [], 0
                held.append((anchor, content, n, data))
                size, last = size + len(data), (anchor, content)
        if held:
            yield from done()

    return sort


def _blocks(batches):
    """(rows, their bytes, sizes, begins, place of the anchor in each) of a bounded number of runs."""
    for batch in batches:
        for at in range(0, batch.num_rows, HASHED_RUNS):
            part = batch.slice(at, HASHED_RUNS)
            pieces = part.column(3).to_pylist()
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            begins = np.cumsum(sizes) - sizes
            text = np.frombuffer(b"".join(pieces), np.uint8)
            places = np.arange(len(text) - GRAM + 1)
            with np.errstate(over="ignore"):
                gram = Hashes(text, 0).of(places, places + GRAM).view(np.int64)
            # A run's first window has the leftmost of equal anchors, and the others share it.
            hit = np.flatnonzero(gram == np.repeat(part.column(0).to_numpy(), sizes)[: len(gram)])
            yield part, text, sizes, begins, hit[np.searchsorted(hit, begins)] - begins


def _side_hashes(length: int):
    """The anchor with half of a window's other bytes before it (side 0) and behind it (side 1), if the run has them.

    A window holds the one or the other, so it can only be repeated if that stands twice.
    """
    half = (length - GRAM) // 2

    def apply(batches):
        for part, text, sizes, begins, place in _blocks(batches):
            for side in (0, 1):
                row = np.flatnonzero(place >= half if side == 0 else place + GRAM + half <= sizes)
                begin = begins[row] + place[row] - (half if side == 0 else 0)
                with np.errstate(over="ignore"):
                    a, b = (Hashes(text, i).of(begin, begin + half + GRAM).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(pa.array(row)) for i in range(3)), pa.array(np.full(len(row), side), pa.int32()), pa.array(a), pa.array(b)],
                    ["anchor", "content", "n", "side", "a", "b"],
                )

    return apply


def _window_hashes(length: int):
    """The windows of each run that hold a side that stands twice, with two hashes of their bytes."""
    half = (length - GRAM) // 2

    def apply(batches):
        for part, text, sizes, begins, place in _blocks(batches):
            windows = sizes - length + 1
            row = np.repeat(np.arange(len(sizes)), windows)
            first = np.arange(len(row)) - (np.cumsum(windows) - windows)[row]
            before = place[row] - first
            left, right = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (4, 5))
            asked = np.where(before >= half, left, False) | np.where(length - GRAM - before >= half, right, False)
            row, first = row[asked], first[asked]
            begin = begins[row] + first
            with np.errstate(over="ignore"):
                a, b = (Hashes(text, i).of(begin, begin + length).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(pa.array(row)) for i in range(3)), pa.array(first, pa.int32()), pa.array(a), pa.array(b)],
                ["anchor", "content", "n", "first", "a", "b"],
            )

    return apply


def _standing_twice(hashed: DataFrame) -> DataFrame:
    often = hashed.groupBy("a", "b").agg(F.sum("n").alias("total")).filter("total >= 2").select("a", "b")
    return hashed.join(often, ["a", "b"])


def _counted_starts(pieces: DataFrame, length: int) -> DataFrame:
    """What ``_sort_shards`` gives, by counting equal windows: for anchors with more runs than a shard may sort."""
    sides = _standing_twice(pieces.mapInArrow(_side_hashes(length), SIDES_SCHEMA)).groupBy("anchor", "content").agg(
        F.max(F.col("side") == 0).alias("left"), F.max(F.col("side") == 1).alias("right")
    )
    asked = pieces.join(sides, ["anchor", "content"]).select("anchor", "content", "n", "data", "left", "right")
    repeated = _standing_twice(asked.mapInArrow(_window_hashes(length), WINDOWS_SCHEMA)).select("anchor", "content", "first")
    # The windows of one run, fewer than ``length``.
    order = Window.partitionBy("anchor", "content").orderBy("first")
    stretch = repeated.withColumn("stretch", F.col("first") - F.row_number().over(order))
    return stretch.groupBy("anchor", "content", "stretch").agg(F.min("first").alias("first"), F.max("first").alias("last")).drop("stretch")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, spans) of every document with repeats; spans are [begin, end) in bytes, merged and in order."""
    counted = _runs(docs, length).groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows")
    )
    counted = materialise(counted, "runs")
    often = counted.groupBy("anchor").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("windows") + length - 1).alias("bytes")
    ).filter("total >= 2")
    often = often.select("anchor", "kinds", ((F.col("kinds") > 1) & (F.col("bytes") > SORT_BYTES)).alias("crowded"))
    candidates = counted.drop("windows").join(often, "anchor")
    places = materialise(_runs(docs, length).join(candidates, ["anchor", "content"]), "run-places")
    # The only run of its anchor, standing at least twice, has nothing to be compared with.
    alone, compared = places.filter("kinds = 1"), places.filter("kinds > 1")
    def cut(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for data, asked in zip(*(c.to_pylist() for c in batch.columns)):
                text = open_.decompress(data)
                rows += [(a["anchor"], a["content"], a["n"], text[a["begin"] : a["begin"] + a["windows"] + length - 1]) for a in asked]
                if len(rows) > 2_000:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)

    def pieces(part: DataFrame) -> DataFrame:
        one = part.groupBy("anchor", "content").agg(
            F.first("n").alias("n"), F.min(F.struct("id", "hash", "begin", "windows")).alias("at")
        ).select("at.id", "at.hash", "anchor", "content", "n", F.col("at.begin").alias("begin"), F.col("at.windows").alias("windows"))
        # The runs asked of one document are no more than its own runs.
        asked = one.groupBy("id", "hash").agg(F.collect_list(F.struct("anchor", "content", "n", "begin", "windows")).alias("asked"))
        return (
            _packed(docs).join(asked, ["id", "hash"]).select("packed", "asked")
            .mapInArrow(cut, "anchor long, content long, n long, data binary")
        )

    starts = materialise(
        pieces(compared.filter("not crowded")).repartition("anchor").sortWithinPartitions("anchor", "content")
        .mapInArrow(_sort_shards(length), STARTS_SCHEMA),
        "repeated-starts",
    )
    if not often.filter("crowded").isEmpty():
        crowd = materialise(pieces(compared.filter("crowded")), "crowded-runs")
        starts = starts.unionByName(materialise(_counted_starts(crowd, length), "crowded-starts"))
    found = compared.join(starts, ["anchor", "content"]).unionByName(
        alone.withColumns({"first": F.lit(0), "last": F.col("windows") - 1})
    )
    spans = found.select(
        "id", "hash", F.struct((F.col("begin") + F.col("first")).alias("begin"), (F.col("begin") + F.col("last") + length).alias("end")).alias("span")
    )
    return spans.groupBy("id", "hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    *whole, data = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in whole), pa.array(data, pa.binary())], ["anchor", "content", "n", "data"])


def without(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside of all spans (in order, may overlap), and the number of stretches removed."""
    kept, at, count = [], 0, 0
    for s in spans or []:
        if count == 0 or s["begin"] > at:
            kept.append(data[at : s["begin"]])
            count += 1
        at = max(at, s["end"])
    kept.append(data[at:])
    return b"".join(kept), count


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same document or
    another. A null text is empty; texts shorter than ``length`` stay; of repeated rows each counts as a document
    of its own, so their repeats go; a null doc_id is kept; an empty table gives no row. Other columns are not
    looked at.
    """

    def apply(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, data, spans in zip(*(c.to_pylist() for c in batch.columns)):
                text = open_.decompress(data)
                kept, count = without(text, spans)
                rows.append((doc_id, len(text), len(text) - len(kept), count, hashlib.sha256(kept).hexdigest()))
            if rows:
                *whole, sha = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in whole), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    found = _packed(docs).join(repeated_spans(docs, length), ["id", "hash"], "left").select("doc_id", "packed", "spans")
    return found.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; a character of which a byte went goes whole. All columns stay;
    ``n_chars``, where there is one, is counted anew. A null text stays null."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else without(t.encode(), s)[0].decode(errors="ignore") if s else t for t, s in zip(texts.to_pylist(), spans.to_pylist())],
            pa.string(),
        )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, own = _keys("doc_id", text)
    names = {"id": "__repeats_id", "hash": "__repeats_hash", "spans": "__repeats_spans"}
    spans = repeated_spans(docs, length).withColumnsRenamed(names)
    same = (key == F.col("__repeats_id")) & (own == F.col("__repeats_hash"))
    out = docs.join(spans, same, "left").withColumn("text", cut(F.col("text").cast("string"), "__repeats_spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop(*names.values())
