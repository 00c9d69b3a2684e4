"""Vector codes: one codebook per quarter of a vector, fitted by ball k-means in whole numbers.

Between rounds a table in the shared folder holds every vector with the entry each of its parts has and the
squared distance to it. One aggregate gives each entry's member count, component sums and radius; that, 256
entries for each part, is all the driver sees. In the next round (all squared, all exact):

* the radius of a moved ball is at most its old radius plus the way its entry moved; only entries within twice
  that radius are neighbours of the ball;
* a ball that did not move, with no moved entry among its neighbours, keeps its members without any distance;
* a part nearer to its entry than half the way to the nearest neighbour is in the stable core and keeps it;
* other parts lie in a ring between the half distances of two consecutive neighbours, and only neighbours up to
  that ring are compared. Equal distances go to the lower index, so a tie counts as inside the ring.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import materialise

PARTS, ENTRIES, SCALE, ROUNDS = 4, 256, 1024, 4
#: Rows with a component of this size or more count as non-finite: their squares leave the range of exact results.
TOO_LARGE = float(2**40)
#: Rows that are compared with entries at a time.
BLOCK = 4096

Codebook = list[np.ndarray]  # per part: entries x components


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): components as floor(1024 * x). Drops null vectors and those with null, non-finite or too large ones."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < TOO_LARGE), F.lit(False)))
    return vectors.filter(F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"),
    )


def _cuts(length: int) -> list[int]:
    return [length * p // PARTS for p in range(PARTS + 1)]


def _numbers(rows: np.ndarray) -> np.ndarray:
    """Doubles where every squared distance between such rows is exact in them, else Python's whole numbers."""
    largest = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
    exact = (2 * largest) ** 2 * max(rows.shape[-1], 1) < 2**53
    return rows.astype(np.float64) if exact else rows.astype(object)


def _both(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and entries as numbers of one exact kind."""
    both = _numbers(np.concatenate([x, c]))
    return both[: len(x)], both[len(x) :]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries (of one exact kind)."""
    return (x * x).sum(1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(1)[None, :]


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, compared with all of them."""
    x, c = _both(x, entries)
    best, far = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for a in range(0, len(x), BLOCK):
        d = distances(x[a : a + BLOCK], c)
        best[a : a + BLOCK] = d.argmin(1)
        far[a : a + BLOCK] = d[np.arange(len(d)), best[a : a + BLOCK]]
    return best, far


class Balls:
    """Neighbours of the entries of one part after they moved; small enough to go to each task (256 x 256 numbers)."""

    def __init__(self, entries: np.ndarray, before: np.ndarray, radius: list[int | None]) -> None:
        self.entries = entries
        moved = [isqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y))) if (x != y).any() else -1 for x, y in zip(entries, before)]
        c = _numbers(entries)
        between = distances(c, c)
        self.near: list[np.ndarray] = []  # neighbours of a ball, nearest first
        self.steps: list[np.ndarray] = []  # their squared distances
        self.stable: list[bool] = []
        for j, r in enumerate(radius):
            # isqrt rounds down, so one more bounds the true length from above.
            reach = 0 if r is None else (isqrt(r) + 1 + moved[j] + 1) ** 2 * 4
            order = [k for k in np.argsort(between[j], kind="stable") if k != j and between[j][k] <= reach]
            self.near.append(np.array(order, np.int64))
            self.steps.append(between[j][order] if order else between[j][:0])
            self.stable.append(moved[j] < 0 and all(moved[k] < 0 for k in order))

    def search(self, x: np.ndarray, code: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance, comparisons) as :func:`full_search` gives, from the codes and distances before the move."""
        x, c = _both(x, self.entries)
        best, far, compared = code.copy(), known.astype(x.dtype), 0
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(c) + 1))
        for j in np.flatnonzero(np.diff(starts)):
            if self.stable[j]:
                continue
            members = order[starts[j] : starts[j + 1]]
            own = ((x[members] - c[j]) ** 2).sum(1)
            far[members] = own
            ring = np.searchsorted(self.steps[j], 4 * own, side="right")
            active = np.flatnonzero(ring)
            if not len(active):
                continue
            rings = ring[active]
            rivals = np.concatenate([self.near[j][: rings.max()], [j]])
            place = np.append(np.arange(rings.max()), -1)
            by_index = np.argsort(rivals)
            rivals, place = rivals[by_index], place[by_index]
            for a in range(0, len(active), BLOCK):
                rows = members[active[a : a + BLOCK]]
                d = distances(x[rows], c[rivals])
                outside = place[None, :] >= rings[a : a + BLOCK, None]
                compared += int((~outside).sum())
                d = np.where(outside, d.max() + 1, d)
                at = d.argmin(1)
                best[rows], far[rows] = rivals[at], d[np.arange(len(d)), at]
        return best, far, compared


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return np.asarray(flat, dtype=np.int64).reshape(len(column), width)


def _wholes(column: pa.Array) -> np.ndarray:
    """Decimals of a list column as longs, or as Python's whole numbers where one is too large; a row per list."""
    flat = column.flatten()
    try:
        values = np.asarray(flat.cast(pa.int64()))
    except pa.ArrowInvalid:
        values = np.array([int(d) for d in flat.to_pylist()], dtype=object)
    return values.reshape(-1, PARTS)


def _decimals(values: np.ndarray) -> pa.Array:
    if values.dtype == object:
        return pa.array([Decimal(int(d)) for d in values], pa.decimal128(38, 0))
    return pa.array(values.astype(np.int64)).cast(pa.decimal128(38, 0))


def assigned(vectors: DataFrame, codebook: Codebook, balls: list[Balls] | None = None) -> DataFrame:
    """(vec_id, label, v, code, far): nearest entry and squared distance of each part, by balls where there are codes before."""
    length = sum(c.shape[1] for c in codebook)
    cuts = _cuts(length)
    kept = vectors.drop("code", "far").columns
    label = vectors.schema["label"].dataType.simpleString()
    shape = f"vec_id long, label {label}, v array<long>, code array<int>, far array<decimal(38,0)>"

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), length)
            if balls is not None:
                code, far = _matrix(batch.column("code"), PARTS), _wholes(batch.column("far"))
            found = []
            for p in range(PARTS):
                x = v[:, cuts[p] : cuts[p + 1]]
                if balls is None:
                    found.append(full_search(x, codebook[p]))
                else:
                    found.append(balls[p].search(x, code[:, p], far[:, p])[:2])
            codes, away = (np.stack([f[k] for f in found], 1).ravel() for k in (0, 1))
            offsets = pa.array(np.arange(0, PARTS * batch.num_rows + 1, PARTS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept],
                    pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32())),
                    pa.ListArray.from_arrays(offsets, _decimals(away)),
                ],
                names=[*kept, "code", "far"],
            )

    return vectors.mapInArrow(assign, shape)


def _members(state: DataFrame, cuts: list[int]) -> dict[tuple[int, int], tuple[int, list[int], int]]:
    """(part, entry) -> (members, component sums, largest squared distance); a task sends one row per entry."""
    length = cuts[-1]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            v, code, far = _matrix(batch.column("v"), length), _matrix(batch.column("code"), PARTS), _wholes(batch.column("far"))
            for p in range(PARTS):
                x = v[:, cuts[p] : cuts[p + 1]]
                order = np.argsort(code[:, p], kind="stable")
                entries, starts = np.unique(code[order, p], return_index=True)
                for j, rows in zip(entries.tolist(), np.split(order, starts[1:])):
                    held = sums.setdefault((p, j), [0, [0] * x.shape[1], 0])
                    held[0] += len(rows)
                    small = np.abs(x[rows]).max(initial=0) < 2**40  # then longs hold the sum of any Arrow batch
                    part = x[rows].sum(0) if small else x[rows].astype(object).sum(0)
                    held[1] = [a + int(b) for a, b in zip(held[1], part)]
                    held[2] = max(held[2], int(far[rows, p].max()))
        keys = list(sums)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([p for p, _ in keys], pa.int32()),
                "entry": pa.array([j for _, j in keys], pa.int32()),
                "n": pa.array([sums[k][0] for k in keys], pa.int64()),
                "far": pa.array([Decimal(sums[k][2]) for k in keys], pa.decimal128(38, 0)),
                "sums": pa.array([[Decimal(s) for s in sums[k][1]] for k in keys], pa.list_(pa.decimal128(38, 0))),
            }
        )

    partial = state.mapInArrow(add, "part int, entry int, n long, far decimal(38,0), sums array<decimal(38,0)>")
    heads = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    totals = partial.select("part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"))
    sums = totals.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).getField("s").alias("sums"))
    rows = heads.join(sums, ["part", "entry"], "left").collect()  # PARTS * ENTRIES rows at most
    return {(r.part, r.entry): (r.n, [int(s) for s in r.sums or []], int(r.far)) for r in rows}


def first_codebook(vectors: DataFrame, length: int) -> Codebook:
    """The parts of the vectors with the smallest ids; nulls come last and equal ids are ordered by their vectors."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    v = np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), length)
    cuts = _cuts(length)
    return [v[:, a:b] for a, b in zip(cuts, cuts[1:])]


def fit(vectors: DataFrame, length: int) -> tuple[DataFrame, Codebook]:
    """Final assignment (a table in the shared folder) and codebook of whole vectors that all have ``length`` components."""
    cuts = _cuts(length)
    codebook, balls = first_codebook(vectors, length), None
    state = vectors
    for _ in range(ROUNDS):
        state = materialise(assigned(state, codebook, balls), "codes")
        members = _members(state, cuts)
        after, balls = [], []
        for p, entries in enumerate(codebook):
            moved = entries.copy()
            for j in range(len(entries)):
                if (p, j) in members:
                    n, sums, _ = members[p, j]
                    moved[j] = [s // n for s in sums]
            balls.append(Balls(moved, entries, [members[p, j][2] if (p, j) in members else None for j in range(len(entries))]))
            after.append(moved)
        codebook = after
    return materialise(assigned(state, codebook, balls), "codes"), codebook


def digest_of(codebook: Codebook) -> str:
    return sha256(",".join(str(int(c)) for part in codebook for entry in part for c in entry).encode()).hexdigest()


def _code(column: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(column[p]), 2, "0") for p in range(PARTS)]))


def encode(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label), one row per kept row (repeated rows and ids too).

    Vectors of different lengths have no distance, so each length has codebooks of its own; a length that 4 does
    not divide gives parts of nearly equal size. Empty vectors have code 00000000. Tables of fewer than 256 rows
    have as many entries as rows. Null labels count as one label; an error beyond a long is null.
    """
    rows = whole_vectors(vectors)
    lengths = sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().collect())
    out = None
    for n in lengths:
        final, codebook = fit(rows.filter(F.size("v") == n), n)
        total = F.aggregate("far", F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)"))
        coded = final.select(
            "vec_id", "label", _code(F.col("code")).alias("code"),
            total.alias("error"), F.lit(digest_of(codebook)).alias("codebooks_sha256"),
        )
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        none = F.lit(None)
        out = rows.select(
            "vec_id", "label", none.cast("string").alias("code"), none.cast("decimal(38,0)").alias("error"),
            none.cast("string").alias("codebooks_sha256"),
        )
    # Sums per label are a written table, so Spark knows its size before it chooses the join.
    sums = materialise(out.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of_label")
    joined = out.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select(
        "vec_id", "code",
        F.expr("try_cast(error AS bigint)").alias("error"),
        F.expr("try_cast(label_error AS bigint)").alias("label_error"),
        "codebooks_sha256", "label",
    )
