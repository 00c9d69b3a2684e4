"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, so that the largest inner product is the smallest distance. Centroids are fitted
on a bounded sample with a price on crowded lists. Every vector goes to its nearest list and, where it stands
near a boundary, to further ones. A query finds near centroids by a search in a graph of them held in
memory and reads the lists whose distance is within a ratio of the nearest one's; the ratio is the smallest
that reaches the wanted recall on the sample. Lists are cut into blocks, so a crowded one is many tasks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import materialise

#: Documented bounds of the fit: sampled vectors, sampled queries, and lists.
SAMPLE_ROWS, SAMPLE_QUERIES, MOST_LISTS = 20_000, 300, 4_096
VECTORS_PER_LIST = 200
#: A vector goes to at most so many lists, of distances within this ratio of its nearest one's.
COPIES, BOUNDARY = 4, 1.3
#: Recall wanted on the sample; above what is asked for, as the sample is a guess.
RECALL = 0.97
#: Rows of a list that one block holds at most, about.
BLOCK_ROWS = 4_096
GRAPH_LINKS = 16
#: Queries that a task searches lists for, about, while there are partitions enough.
TASK_QUERIES = 64
#: Queries whose best a task holds before it gives them.
HELD_QUERIES = 100_000
FOUND_SCHEMA = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """Everything that tasks need: bounded by ``MOST_LISTS``, not by the number of vectors."""

    centroids: np.ndarray
    links: np.ndarray
    norm: float
    ratio: float
    reach: int
    sizes: np.ndarray


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm**2 - (vectors.astype(float) ** 2).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], 1).astype(np.float32)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squared = (vectors**2).sum(1)[:, None] - 2 * vectors @ centroids.T + (centroids**2).sum(1)
    return np.sqrt(np.maximum(squared, 0))


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means whose assignment adds a price for crowded lists; empty lists move to the largest one."""
    rng = np.random.default_rng(8)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    price = np.zeros(lists, np.float32)
    for _ in range(rounds):
        d = distances(sample, centroids) ** 2
        nearest = (d + price).argmin(1)
        n = np.bincount(nearest, minlength=lists)
        price = (0.1 * float(d.min(1).mean()) * (n / n.mean() - 1)).astype(np.float32)
        for i in range(lists):
            own = sample[nearest == i] if n[i] else sample[nearest == n.argmax()][: 1 + i % 5]
            centroids[i] = own.mean(0)
    return centroids


def linked(centroids: np.ndarray) -> np.ndarray:
    """Graph for the search: each centroid's nearest ones and a few far ones."""
    n = len(centroids)
    near = np.argsort(distances(centroids, centroids), 1, kind="stable")[:, 1 : GRAPH_LINKS + 1]
    rng = np.random.default_rng(9)
    return np.concatenate([near, rng.integers(0, n, (n, 4))], 1)


def graph_search(query: np.ndarray, index: Index, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """About the ``reach`` nearest centroids, nearest first, by best-first search from a few entries."""
    n = len(index.centroids)
    reach = min(reach, n)
    seen = np.zeros(n, bool)
    start = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
    seen[start] = True
    d = distances(query[None], index.centroids[start])[0]
    todo = list(zip(d.tolist(), start.tolist()))
    heapq.heapify(todo)
    best = [(-x, i) for x, i in todo]
    heapq.heapify(best)
    while todo:
        far, i = heapq.heappop(todo)
        if len(best) >= reach and far > -best[0][0]:
            break
        new = index.links[i][~seen[index.links[i]]]
        if len(new):
            new = np.unique(new)
            seen[new] = True
            for x, j in zip(distances(query[None], index.centroids[new])[0].tolist(), new.tolist()):
                if len(best) < reach or x < -best[0][0]:
                    heapq.heappush(todo, (x, j))
                    heapq.heappush(best, (-x, j))
                    if len(best) > reach:
                        heapq.heappop(best)
    found = sorted((-x, i) for x, i in best)
    return np.array([i for _, i in found]), np.array([x for x, _ in found])


def lists_of(vectors: np.ndarray, index: Index) -> list[np.ndarray]:
    """The lists that each (augmented) vector stands in."""
    d = distances(vectors, index.centroids)
    order = np.argsort(d, 1, kind="stable")[:, :COPIES]
    near = np.take_along_axis(d, order, 1)
    return [o[x <= BOUNDARY * max(x[0], 1e-6)] for o, x in zip(order, near)]


def probes(query: np.ndarray, index: Index, least: int) -> np.ndarray:
    """Lists to read: within the ratio of the nearest, and more until ``least`` vectors are in reach."""
    found, far = graph_search(query, index, index.reach)
    enough = int(np.searchsorted(np.cumsum(index.sizes[found]), least * COPIES)) + 1
    wanted = max(enough, int((far <= index.ratio * max(far[0], 1e-6)).sum()))
    if wanted > len(found):
        rest = distances(query[None], index.centroids)[0]
        return np.argsort(rest, kind="stable")[:wanted]
    return found[:wanted]


def calibrate(index: Index, sample: np.ndarray, k: int) -> None:
    """Set ratio and reach so that sampled queries find ``RECALL`` of their neighbours in the sample."""
    rng = np.random.default_rng(10)
    queries = rng.permutation(len(sample))[:SAMPLE_QUERIES]
    vectors = augmented(sample, index.norm)
    lists = lists_of(vectors, index)
    asked = np.concatenate([sample[queries], np.zeros((len(queries), 1), np.float32)], 1)
    near = distances(asked, index.centroids)
    needed = []
    for q, row in zip(queries, near):
        score = sample.astype(float) @ sample[q].astype(float)
        score[q] = -np.inf
        top = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        needed += [row[lists[t]].min() / max(row.min(), 1e-6) for t in top]
    index.ratio = float(np.quantile(needed, RECALL)) if needed else 1.0
    index.reach = int(min(len(index.centroids), 8 + 1.2 * np.quantile((near <= index.ratio * near.min(1, keepdims=True)).sum(1), 0.95)))


def usable(table: DataFrame) -> DataFrame:
    """vec_id and the vector (doubles) of rows that take part, and its norm.

    Left out: a null vec_id; vectors null, empty, zero or with null or non-finite components.
    """
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null")
    rows = rows.filter(F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)))
    rows = rows.filter(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def fit(rows: DataFrame, total: int, norm: float, k: int) -> Index:
    order = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    share = min(1.0, 1.3 * SAMPLE_ROWS / total)
    sampled = rows.filter(order < int(share * (1 << 20)) + 1).orderBy(order, "vec_id").limit(SAMPLE_ROWS).select("v")
    # A bounded sample: SAMPLE_ROWS vectors at most.
    sample = np.stack(sampled.toPandas()["v"].to_numpy()).astype(np.float32)
    lists = max(1, min(MOST_LISTS, len(sample) // 4, math.ceil(total / VECTORS_PER_LIST)))
    centroids = balanced_centroids(augmented(sample, norm), lists)
    index = Index(centroids, linked(centroids), norm, 1.0, lists, np.zeros(lists, np.int64))
    calibrate(index, sample, k)
    return index


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def posting_lists(rows: DataFrame, sent) -> DataFrame:
    def post(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                own = lists_of(augmented(v, sent.value.norm), sent.value)
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own), pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                    ["list", "vec_id", "v"],
                )

    return rows.select("vec_id", "v").mapInArrow(post, "list int, vec_id long, v array<double>")


def nearest(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest of each query found: query_id, rank, vec_id, score (the inner product in doubles).

    Queries are rows whose vec_id is divisible by ``every``; candidates all rows but those of the query's own vec_id.
    Ties go to the smaller vec_id; repeated rows of one vec_id count once, with their best score, and as one query.
    Rows that ``usable`` leaves out are no queries and no candidates. Only vectors of one length have an inner
    product: each length of the table gets an index of its own. An empty table gives no row.
    """
    rows = usable(table).withColumn("size", F.size("v"))
    lengths = rows.groupBy("size").agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("norm"))
    # One row per length of vectors; a table of embeddings has one or a few.
    found = [_nearest_of_length(rows.filter(F.col("size") == x["size"]), x["rows"], x["norm"], every, k) for x in lengths.orderBy("size").collect()]
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # An id that several lists or tasks gave counts once, with its best score.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(rows: DataFrame, total: int, norm: float, every: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each task for vectors that have one length; an id may repeat."""
    index = fit(rows, total, norm, k)
    spark = rows.sparkSession
    context = spark.sparkContext
    posted = materialise(posting_lists(rows, context.broadcast(index)), "postings")
    for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per list
        index.sizes[r["list"]] = r["n"]
    sent = context.broadcast(index)
    cuts = np.maximum(1, np.ceil(index.sizes / BLOCK_ROWS)).astype(int).tolist()
    blocks = F.element_at(F.array(*[F.lit(w) for w in cuts]) if max(cuts) > 1 else F.array_repeat(F.lit(1), len(cuts)), F.col("list") + 1)

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                asked = np.concatenate([v, np.zeros((len(v), 1))], 1).astype(np.float32)
                own = [probes(q, sent.value, k) for q in asked]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own), pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                    ["list", "vec_id", "v"],
                )

    # A width of its own: few rows, but each is a search through the graph.
    width = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / every / TASK_QUERIES))
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v").repartition(width, "vec_id").dropDuplicates(["vec_id", "v"])
    asked = queries.mapInArrow(ask, "list int, vec_id long, v array<double>")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("query", F.lit(True))
    stored = posted.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("query", F.lit(False))
    return (
        stored.unionByName(asked).repartition("list", "block").sortWithinPartitions("list", "block", "query", "vec_id")
        .select("list", "block", "query", "vec_id", "v").mapInArrow(_meet(k), FOUND_SCHEMA)
    )


def _meet(k: int):
    """Score the queries of each block against its vectors; rows of a block come in a row, vectors first.

    A task keeps the best of each query over all its blocks and gives them at its end, or earlier when it
    has met ``HELD_QUERIES`` of them, so the rows grow with the queries and not with the lists they read.
    """

    def meet(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own, ids, vectors = None, [], []
        for batch in batches:
            lists, blocks, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vec_id, v = batch.column(3).to_numpy(), matrix(batch.column(4))
            cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(blocks) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for at in np.split(np.arange(len(lists)), cuts):
                if not len(at):
                    continue
                name = (int(lists[at[0]]), int(blocks[at[0]]))
                if name != own:
                    own, ids, vectors = name, [], []
                if not query[at[0]]:
                    ids.append(vec_id[at])
                    vectors.append(v[at])
                elif ids:
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for part in np.array_split(at, len(at) // 64 + 1):
                        _keep_best(ids[0], vectors[0], vec_id[part], v[part], held, k)
            if len(held) > HELD_QUERIES:
                yield from _given(held)
                held = {}
        yield from _given(held)

    return meet


def _keep_best(ids, vectors, asked, queries, held: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> None:
    # One fixed order of additions per pair, so that equal vectors have equal scores in every block.
    score = np.einsum("ij,kj->ik", queries, vectors)
    score[asked[:, None] == ids[None, :]] = -np.inf
    for q, own in zip(asked.tolist(), score):
        before = held.get(q)
        floor = before[1][-1] if before is not None and len(before[1]) == k else -np.inf
        keep = np.flatnonzero((own >= floor) & (own > -np.inf))
        if not len(keep):
            continue
        if len(keep) > 4 * k:
            # Only what is at least as near as the k-th can matter; an id may stand in a list more than once.
            keep = keep[np.lexsort((ids[keep], -own[keep]))]
            keep = keep[np.sort(np.unique(ids[keep], return_index=True)[1])[:k]]
        all_ids, all_scores = ids[keep], own[keep]
        if before is not None:
            all_ids, all_scores = np.concatenate([before[0], all_ids]), np.concatenate([before[1], all_scores])
        order = np.lexsort((all_ids, -all_scores))
        all_ids, all_scores = all_ids[order], all_scores[order]
        first = np.sort(np.unique(all_ids, return_index=True)[1])[:k]
        held[q] = (all_ids[first], all_scores[first])


def _given(held: dict[int, tuple[np.ndarray, np.ndarray]]):
    names = list(held)
    for at in range(0, len(names), 4_096):
        part = names[at : at + 4_096]
        n = [len(held[q][0]) for q in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(part), n)), pa.array(np.concatenate([held[q][0] for q in part])),
             pa.array(np.concatenate([held[q][1] for q in part]))],
            ["query_id", "vec_id", "score"],
        )
