"""Near-duplicates by SimHash fingerprints and the general pigeonhole rule.

A fingerprint of 64 bits is cut into parts of correlated bits. Two fingerprints with at most ``k`` differing
bits have, for any thresholds t_i >= -1 with sum k - parts + 1, a part i where at most t_i bits differ.
Each fingerprint takes the thresholds that a dynamic program finds cheapest from the counts of its
parts' values, so very common values are not searched but by the few fingerprints that must.
Whole documents never meet: equal fingerprints are one node, buckets of parts give only a spanning
forest of their links, and components of the links are found by star contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import keyed_texts, materialise, slices
from beaconry.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
PARTS = 3
#: A value that at least this share of all fingerprints has in a part counts as common.
COMMON_SHARE = 1 / 2048


def fingerprint(text: str) -> int:
    """Majority of the bits of the hashes of all word triples, repeats included; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-SHINGLE] + 1])
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.array(hashes[at : at + (1 << 14)], "<u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and text_hash of every row."""

    def apply(batches):
        for batch in slices(batches):
            fps = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2)], ["doc_id", "fp", "text_hash"])

    return keyed_texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(apply, "doc_id long, fp long, text_hash long")


def correlated_parts(both: np.ndarray, total: int) -> list[list[int]]:
    """Cut the 64 bits into parts so that bits which go together share a part.

    both[i, j] counts fingerprints with bits i and j set. Parts are filled one bit at a time with
    the bit that correlates most with those already there.
    """
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, parts = set(range(64)), []
    for size in (64 // PARTS + (i < 64 % PARTS) for i in range(PARTS)):
        pool = sorted(left)
        part = [max(pool, key=lambda b: corr[b, pool].sum())]
        while len(part) < size:
            rest = sorted(left.difference(part))
            part.append(rest[int(np.argmax(corr[np.ix_(rest, part)].sum(1)))])
        parts.append(sorted(part))
        left -= set(part)
    return parts


def values_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        out |= (fps >> b & 1) << i
    return out


def flips(width: int, most: int) -> np.ndarray:
    """Masks of at most ``most`` bits out of ``width``, by number of bits."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)], np.int64)


def allocate(values: list[np.ndarray], widths: list[int], common: list[dict[int, int]], total: int, k: int) -> np.ndarray:
    """Thresholds (rows x parts, -1 to k) with least estimated work and sum k - parts + 1.

    Work of part i at threshold t: probes sent, and fingerprints expected to have one of the probed
    values (exact for common values, else the mean). Dynamic program over parts and spent budget.
    """
    n, budget = len(values[0]), k + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for v, width, known in zip(values, widths, common):
        cost = np.zeros((n, budget + 1))
        mean = max(0.0, (total - sum(known.values())) / 2**width)
        masks = 0
        for t in range(k + 1):
            masks = len(flips(width, t))
            cost[:, t + 1] = masks * (1 + mean)
        for value, count in known.items():
            far = np.bitwise_count(v ^ value)
            for t in range(k + 1):
                cost[far <= t, t + 1] += count
        options = np.stack([
            np.min(np.stack([best[:, b - t] + cost[:, t] for t in range(b + 1)], 1), 1) for b in range(budget + 1)
        ], 1)
        picks.append(np.stack([
            np.argmin(np.stack([best[:, b - t] + cost[:, t] for t in range(b + 1)], 1), 1) for b in range(budget + 1)
        ], 1))
        best = options
    out, left = np.zeros((n, len(values)), np.int64), np.full(n, budget)
    for i in range(len(values) - 1, -1, -1):
        t = picks[i][np.arange(n), left]
        out[:, i], left = t - 1, left - t
    return out


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of a small graph, without the roots themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within runs of equal keys, at least one of the two being a probe; sorted by key."""
    found, at, step = [], np.arange(len(key)), 1
    while len(at := at[at + step < len(key)]):
        at = at[key[at] == key[at + step]]
        near = at[(probe[at] | probe[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= k)]
        found.append((fp[near], fp[near + step]))
        step += 1
    if not found:
        return fp[:0], fp[:0]
    return tuple(np.concatenate(x) for x in zip(*found))


def link_forest(nodes: DataFrame, k: int = DISTANCE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join all pairs with <= k differing bits."""

    def pairs_of_bits(batches):
        total, both = 0, np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, both = total + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(4097)), pa.array(np.append(both.ravel(), total).astype(np.int64))], ["cell", "n"]
        )

    # 4097 numbers, whatever the size of the corpus.
    cells = nodes.select("fp").mapInArrow(pairs_of_bits, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = cells.set_index("cell")["n"].reindex(range(4097), fill_value=0).to_numpy()
    total = int(cells[4096])
    parts = correlated_parts(cells[:4096].reshape(64, 64), total)
    widths = [len(p) for p in parts]

    def values(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i, bits in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i)), pa.array(values_of(fps, bits))], ["part", "value"])

    # At most 1 / COMMON_SHARE values per part can be common.
    counted = nodes.select("fp").mapInArrow(values, "part long, value long").groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    common: list[dict[int, int]] = [{} for _ in parts]
    for row in counted.filter(F.col("n") >= max(64, int(total * COMMON_SHARE))).collect():
        common[row["part"]][row["value"]] = row["n"]
    masks = [[flips(w, t) if t >= 0 else np.zeros(0, np.int64) for t in range(k + 1)] for w in widths]
    rest = [np.array_split([b for b in range(64) if b not in p], k + 1) for p in parts]

    def deal(batches):
        """Rows (key, fp, probe): every fingerprint stands under the value of each part and probes values
        within its threshold. Under common values the remaining bits are cut once more into k + 1 pieces, one of
        which must agree exactly."""
        for batch in batches:
            fps = batch.column(0).to_numpy()
            own = [values_of(fps, p) for p in parts]
            limits = allocate(own, widths, common, total, k)
            for i, part in enumerate(parts):
                rows = [(own[i], fps, limits[:, i] >= 0)]
                for t in range(1, k + 1):
                    who = np.flatnonzero(limits[:, i] >= t)
                    for mask in masks[i][t][len(masks[i][t - 1]) :]:
                        rows.append((own[i][who] ^ mask, fps[who], np.ones(len(who), bool)))
                value, fp, probe = (np.concatenate(x) for x in zip(*rows))
                often = np.isin(value, np.array(list(common[i]), np.int64))
                yield _dealt(i, 0, value[~often], 0, fp[~often], probe[~often])
                for j, piece in enumerate(rest[i]):
                    if often.any():
                        yield _dealt(i, j + 1, value[often], values_of(fp[often], piece.tolist()), fp[often], probe[often])

    def join(batches):
        key, fp, probe = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            a, b, f, p = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key, fp, probe = np.concatenate([key, np.stack([a, b], 1)]), np.concatenate([fp, f]), np.concatenate([probe, p])
            # The last bucket may go on in the next batch.
            done = int(np.flatnonzero((key[1:] != key[:-1]).any(1))[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
            if done:
                yield _forest(key[:done], fp[:done], probe[:done], k)
                key, fp, probe = key[done:], fp[done:], probe[done:]
        if len(key):
            yield _forest(key, fp, probe, k)

    return (
        nodes.select("fp").mapInArrow(deal, "a long, b long, fp long, probe boolean")
        .groupBy("a", "b", "fp").agg(F.max("probe").alias("probe"))
        .repartition("a", "b").sortWithinPartitions("a", "b", "fp")
        .mapInArrow(join, "u long, v long")
    )


def _dealt(part: int, piece: int, value, cell, fp, probe) -> pa.RecordBatch:
    a = np.int64(part * 8 + piece) << 32 | value
    b = np.full(len(a), cell) if np.isscalar(cell) else cell
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(fp), pa.array(probe)], ["a", "b", "fp", "probe"])


def _forest(key, fp, probe, k: int) -> pa.RecordBatch:
    whole = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(1)]))
    u, v = _roots(*_bucket_links(whole, fp, probe, k))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def near_duplicates(docs: DataFrame, k: int = DISTANCE) -> DataFrame:
    """Per row: doc_id, fp, text_hash and component_id, the smallest doc_id that links reach.

    Links join fingerprints with at most ``k`` differing bits. A null or blank text has fingerprint zero and is
    linked like any other; rows without doc_id take part and get the smallest id of their component (null if
    it has none); repeated rows and ids stay; an empty table gives no row. Other columns are not looked at.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(link_forest(nodes, k))
    classes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "text_hash", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame, k: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that remain when of each component one document stays: that with the smallest id,
    and among rows of that id the one with the smallest hash. All columns are kept."""
    found = near_duplicates(docs, k).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy(F.col("component_id").alias("__keep_id")).agg(F.min("text_hash").alias("__keep_hash"))
    own_id = F.col("doc_id").cast("long")
    own_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(keep, own_id.eqNullSafe(F.col("__keep_id")) & (own_hash == F.col("__keep_hash")), "left_semi")
    same = Window.partitionBy(own_id, own_hash).orderBy(F.lit(0))
    return kept.withColumn("__copy", F.row_number().over(same)).filter("__copy = 1").drop("__copy")
