"""Near-duplicates against brute force over all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from beaconry.llm import graph, simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def brute_components(values, k=2):
    u = np.array(sorted(set(values)), np.int64)
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= k):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {int(x): int(u[find(i)]) for i, x in enumerate(u)}


def dense(seed, n):
    """Random fingerprints, chains, and a crowd around one of them."""
    rng = np.random.default_rng(seed)
    far = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    chain = np.bitwise_xor.accumulate(np.concatenate([far[:1], np.int64(1) << rng.integers(0, 63, 40)]))
    crowd = np.repeat(far[1], 6 * n)
    for _ in range(3):
        crowd = crowd ^ (np.int64(1) << rng.integers(0, 64, len(crowd), dtype=np.int64))
    return np.unique(np.concatenate([far, chain, crowd, crowd[:50] ^ np.int64(5)]))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_join_all_near_pairs(spark, seed):
    values = dense(seed, 300)
    nodes = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in graph.components(simhash.link_forest(nodes)).collect()}
    want = brute_components(values.tolist())
    assert {v: got.get(v, v) for v in want} == want


def test_every_allocation_spends_the_budget():
    rng = np.random.default_rng(3)
    values = [rng.integers(0, 1 << 21, 500) for _ in range(3)]
    common = [{int(v[0]): 400} for v in values]
    limits = simhash.allocate(values, [21, 21, 22], common, 500, 2)
    assert (limits.sum(1) == 0).all() and limits.min() >= -1 and limits.max() <= 2
    assert (limits[0] == limits[0]).all() and len(np.unique(limits, axis=0)) >= 1


def test_fingerprint_counts_bits_of_all_shingles():
    def slow(text):
        words = text.encode().lower().split()
        if not words:
            return 0
        shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ["", " \n", "one", "One two", "one TWO three", "É é é x", "a b c d e a b c d", "w " * 40_000, "no\xa0break here ok"]:
        assert simhash.fingerprint(text) & (2**64 - 1) == slow(text)


def test_odd_rows_and_one_of_each(spark):
    text = "some words that are long enough to be a document of their own and more"
    rows = [(5, text, "x"), (3, text, "y"), (3, text, "y"), (9, None, "z"), (8, "  ", "q"), (None, "quite another text here", None), (None, text, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, None), (None, 3)], key=str)
    kept = sorted(((r["doc_id"], r["fp"]) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(3, "y"), (8, "q"), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
