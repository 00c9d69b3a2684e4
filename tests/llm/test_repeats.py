"""Suffix order and removal of repeats against plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from beaconry.llm import anchors, repeats
from beaconry.llm.suffixes import suffix_order

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("hash", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.mark.parametrize("most_rows", [3, 100_000])
def test_suffix_order_and_prefixes(most_rows):
    rng = np.random.default_rng(0)
    for trial in range(60):
        text = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        text = np.append(np.tile(text, 3) if trial % 3 == 0 else text, 0)
        s = text.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        common = [0]
        for a, b in zip(want, want[1:]):
            n = 0
            while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            common.append(n)
        order, found = suffix_order(text, 6, 400, most_rows)
        assert order.tolist() == want and found.tolist() == common


def test_every_window_has_one_run_and_equal_windows_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 101, 500).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() + passage for n in (0, 5, 190, 700)] + [b"", b"x" * 199, b"y" * 450]
    seen = {}
    row, begin, windows, anchor, _ = anchors.runs(texts, 200)
    starts = Counter()
    for r, b, n, a in zip(row, begin, windows, anchor):
        for s in range(b, b + n):
            starts[r, s] += 1
            assert seen.setdefault(texts[r][s : s + 200], a) == a
    assert starts == Counter((r, s) for r, t in enumerate(texts) for s in range(len(t) - 199))


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_removed_bytes_equal_plain_search(spark):
    rng = np.random.default_rng(2)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh é"), n))

    passage, page = noise(400), noise(900)
    rows = [(n, noise(int(rng.integers(0, 300))) + passage[int(rng.integers(0, 150)) :] + noise(50)) for n in range(40)]
    rows += [(50, page), (51, page), (52, page[:450] + "#" + page[451:]), (53, page[100:299]), (54, "z" * 1_500), (55, "ab" * 300)]
    rows += [(60, None), (61, ""), (62, noise(199)), (63, page[:200]), (None, page[300:700]), (50, page), (64, noise(60_000) + passage)]
    docs = spark.createDataFrame([(i, t, "x", None, "s", -1) for i, t in rows], DOCS)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200))), key=str)
    got = sorted((tuple(r) for r in repeats.digest(docs).collect()), key=str)
    assert got == want
    cut = repeats.deduplicated(docs)
    assert cut.columns == docs.columns
    left = {r["doc_id"]: r for r in cut.collect()}
    assert left[60]["text"] is None and left[51]["text"] == "" and left[51]["n_chars"] == 0 and left[62]["text"] == rows[48][1]
    assert repeats.digest(docs.limit(0)).count() == 0 and repeats.deduplicated(docs.limit(0)).count() == 0


def test_a_crowd_of_one_passage(spark):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefghij "), 260))
    rows = [(n, f"{n:07d}" + passage + f"{n:07d}") for n in range(1_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], DOCS)
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200))]
    assert sorted(tuple(r) for r in repeats.digest(docs).collect()) == want


def test_an_anchor_with_more_runs_than_a_shard_may_sort(spark, monkeypatch):
    rng, sort = np.random.default_rng(4), repeats._sort_shards
    least = min(range(3_000), key=lambda n: anchors.Hashes(np.frombuffer(f"line {n:043d}".encode(), np.uint8), 0).of(np.array([0]), np.array([48]))[0])
    line = f"line {least:043d}"
    sides = ["".join(rng.choice(list("abcdefghij "), 160)) for _ in range(6_000)]
    rows = [(n, sides[n] + line + sides[-n][:150]) for n in range(6_000)]
    # Some windows stand twice, left or right of the line, with other surroundings, and some texts whole.
    rows += [(n + 10_000, sides[n][-140:] + line + "x" * 150) for n in range(40)] + [(n + 20_000, rows[n][1]) for n in range(100, 120)]
    most = repeats.SORT_BYTES

    def bounded(length):
        def check(batches):
            sizes = {}

            def seen():
                for batch in batches:
                    for anchor, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                        sizes[anchor] = sizes.get(anchor, 0) + len(data)
                        assert sizes[anchor] <= most
                    yield batch

            return sort(length)(seen())

        return check

    monkeypatch.setattr(repeats, "_sort_shards", bounded)
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], DOCS)
    want = sorted((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200)))
    assert sorted(tuple(r) for r in repeats.digest(docs).collect()) == want


@pytest.mark.parametrize("most", [0, 3_000])
def test_counted_windows_give_the_same_as_sorted_ones(spark, monkeypatch, most):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefghij é"), 330))
    rows = [(n, f"{n % 30:07d}" + passage[n % 90 :] + f"{n:07d}") for n in range(200)] + [(900, "z" * 700), (901, "ab" * 300)]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], DOCS)
    monkeypatch.setattr(repeats, "SORT_BYTES", most)
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200))]
    assert sorted(tuple(r) for r in repeats.digest(docs).collect()) == want


def test_cut_characters_go_whole(spark):
    docs = spark.createDataFrame([(1, "é" * 100 + "a", None, None, None, 0), (2, "b" + "é" * 100, None, None, None, 0)], DOCS)
    left = {r["doc_id"]: r["text"] for r in repeats.deduplicated(docs).collect()}
    assert left == {1: "a", 2: "b"}
