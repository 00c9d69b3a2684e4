"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from beaconry.llm import neighbours

TABLE = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("v", T.StringType()), T.StructField("norm", T.StringType()), T.StructField("list", T.StringType()),
])


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", None, "y") for i, v in rows], TABLE)


def brute(rows, every=20, k=20):
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None}
    ids = np.array(sorted(fine))
    vectors = np.stack([fine[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        score = vectors @ fine[q]
        score[ids == q] = -np.inf
        order = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        out[int(q)] = [(int(ids[o]), float(score[o])) for o in order]
    return out


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_exact_scores(spark, scaled):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3_000, 24)) * (rng.uniform(0.5, 2, (3_000, 1)) if scaled else 1)
    vectors[100:700] = vectors[100]
    rows = [(n, v.astype(np.float32).tolist()) for n, v in enumerate(vectors)]
    want, got = brute(rows), got_of(neighbours.nearest(table_of(spark, rows)))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and all(np.isclose(s, np.dot(np.float64(np.float32(vectors[q])), np.float64(np.float32(vectors[i])))) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    # Six hundred equal vectors: the smallest ids among them, in order.
    assert [i for i, _ in got[200]][:3] == [i for i, _ in want[200]][:3]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (20, [1.0, 1.0]), (1, [0.5, 0.5])]
    odd = [(3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    got = got_of(neighbours.nearest(table_of(spark, rows + odd)))
    assert got == {0: [(20, 1.0), (1, 0.5), (2, 0.0)], 20: [(0, 1.0), (1, 1.0), (2, 1.0)]}
    assert neighbours.nearest(table_of(spark, odd[:6])).count() == 0
    assert neighbours.nearest(table_of(spark, [])).count() == 0


def test_each_length_is_searched_for_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(size=4 if n % 3 else 7).astype(np.float32).tolist()) for n in range(400)] + [(440, [1.0] * 5)]
    got, want = got_of(neighbours.nearest(table_of(spark, rows))), {}
    for size in (4, 7):
        want |= brute([r for r in rows if len(r[1]) == size])
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_an_id_with_different_vectors_counts_once(spark, monkeypatch):
    met = [(0, i, 1 / (1 + i + 100 * copy)) for i in range(1, 41) for copy in range(3)] + [(0, 1, 1 - n / 100) for n in range(30)]
    monkeypatch.setattr(neighbours, "_meet", lambda k: _given_rows(met))
    rows = [(n, [1.0, float(n)]) for n in range(50)]
    got = got_of(neighbours.nearest(table_of(spark, rows)).filter("query_id = 0"))
    assert got == {0: [(1, 1.0)] + [(i, 1 / (1 + i)) for i in range(2, 21)]}


def _given_rows(rows):
    """A scoring step whose first task gives ``rows``."""

    def give(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for _ in batches:
            pass
        if TaskContext.get().partitionId() == 0:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s)], ["query_id", "vec_id", "score"])

    return give
