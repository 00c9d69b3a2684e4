"""Packing of token sequences by non-negative least squares over the histogram of lengths.

Documents are cut into full windows and one remainder. The plan depends only on how many remainders
there are of each length (at most ``window`` numbers, however large the corpus): combinations of up to
three lengths that fill a window exactly are enumerated, repeat counts are solved by non-negative
least squares against the histogram and rounded, and what is left over is packed greedily, longest
first, with a cut where a gap remains. Remainders then find their place by their rank among those of
equal length; ranks come from counts by (length, bucket), so no length owns a task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.common import keyed_texts, materialise, slices
from beaconry.llm.records import END_ID
from beaconry.llm.tokens import default_path, encoder

WINDOW = 1024
#: A length's pieces are ranked within so many buckets.
BUCKETS = 512
PIECES_SCHEMA = "doc_id long, start long, length long, doc_tokens long, wide boolean, ids binary"
PLACED_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


@dataclass
class Plan:
    """Row r: pieces of length ``length`` with lo <= rank < hi put their ids [part, part + size) into
    sequence ``base + rank - lo`` at ``offset``. Rows of one (length, lo) stand together."""

    length: np.ndarray
    lo: np.ndarray
    part: np.ndarray
    size: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All multisets of two or three of the lengths that sum to the window; 0 fills the third place."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = []
    for a in lengths.tolist():
        if 2 * a <= window and have[window - a]:
            out.append(np.array([[a, window - a, 0]]))
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[have[window - a - b]]
        if len(b):
            out.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def solve_repeats(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' use of each length near to ``counts``.

    Accelerated projected gradient for min |Ax - counts|^2 with x >= 0; column j of A counts how often
    combination j holds each length. Index 0 is the empty place and has no weight.
    """
    if not len(combos):
        return np.zeros(0)
    use = np.bincount(combos.ravel(), minlength=len(counts)).astype(float)
    use[0] = 0
    step = 1.0 / (3.0 * use.max())
    weight = (combos > 0).astype(float)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        off = np.bincount(combos.ravel(), weights=(weight * y[:, None]).ravel(), minlength=len(counts)) - counts
        off[0] = 0
        new = np.maximum(0.0, y - step * off[combos].sum(1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def rounded(combos: np.ndarray, repeats: np.ndarray, counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts, the largest first, never more than the lengths that are there."""
    left, out = counts.copy(), []
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] < 0.5:
            break
        parts = [int(c) for c in combos[j] if c]
        most = min(left[p] // parts.count(p) for p in parts)
        n = int(min(round(repeats[j]), most))
        if n > 0:
            for p in parts:
                left[p] -= n
            out.append((tuple(parts), n))
    return out


class _Stock:
    """What is left of each length: runs of ranks of an original length, from a place within it."""

    def __init__(self, counts: np.ndarray):
        self.runs: dict[int, deque] = defaultdict(deque)
        self.total: dict[int, int] = {}
        self.lengths: list[int] = []
        for length in np.flatnonzero(counts).tolist():
            self.add(length, (length, 0, 0, int(counts[length])))

    def add(self, size: int, run: tuple[int, int, int, int]) -> None:
        if not self.total.get(size):
            bisect.insort(self.lengths, size)
            self.total[size] = 0
        self.runs[size].append(run)
        self.total[size] += run[3]

    def take(self, size: int, n: int) -> list[tuple[int, int, int, int]]:
        self.total[size] -= n
        if not self.total[size]:
            self.lengths.remove(size)
        out = []
        while n:
            length, part, lo, have = self.runs[size].popleft()
            k = min(n, have)
            out.append((length, part, lo, k))
            if have > k:
                self.runs[size].appendleft((length, part, lo + k, have - k))
            n -= k
        return out


def make_plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """Plan for a histogram: counts[l] pieces of length l, 0 < l <= window."""
    counts = counts.astype(np.int64)
    stock, rows, used = _Stock(counts), [], 0

    def place(size: int, n: int, base: int, offset: int) -> None:
        for length, part, lo, k in stock.take(size, n):
            rows.append((length, lo, k, part, size, base, offset))
            base += k

    full = int(counts[window])
    if full:
        place(window, full, 0, 0)
        used = full
    open_counts = counts.copy()
    open_counts[window] = 0
    combos = combinations(np.flatnonzero(open_counts), window)
    for parts, n in rounded(combos, solve_repeats(combos, open_counts.astype(float)), open_counts):
        offset = 0
        for p in parts:
            place(p, n, used, offset)
            offset += p
        used += n

    while stock.lengths:
        parts, cut, gap = [stock.lengths[-1]], 0, window - stock.lengths[-1]
        while gap:
            at = bisect.bisect_right(stock.lengths, gap) - 1
            while at >= 0 and stock.total[stock.lengths[at]] <= parts.count(stock.lengths[at]):
                at -= 1
            if at >= 0:
                parts.append(stock.lengths[at])
                gap -= parts[-1]
                continue
            longer = stock.lengths[bisect.bisect_right(stock.lengths, gap) :]
            cut = next((s for s in longer if stock.total[s] > parts.count(s)), 0)
            break
        need = [*parts, cut] if cut else parts
        n = min(stock.total[s] // need.count(s) for s in set(need))
        if gap and not cut:
            used = _tail(stock, rows, parts, used)
            continue
        offset = 0
        for p in parts:
            place(p, n, used, offset)
            offset += p
        if cut:
            base = used
            for length, part, lo, k in stock.take(cut, n):
                rows.append((length, lo, k, part, gap, base, offset))
                stock.add(cut - gap, (length, part + gap, lo, k))
                base += k
        used += n

    return _as_plan(rows, counts, used)


def _tail(stock: _Stock, rows: list, parts: list[int], used: int) -> int:
    """The last ids do not fill a window: cut them into sequences whose lengths are powers of two."""
    total = sum(parts)
    room = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    offset = 0
    for size in parts:
        ((length, part, lo, _),) = stock.take(size, 1)
        while size:
            k = min(size, room[0] - offset)
            rows.append((length, lo, 1, part, k, used, offset))
            part, size, offset = part + k, size - k, offset + k
            if offset == room[0]:
                room.pop(0)
                used, offset = used + 1, 0
    return used


def _as_plan(rows: list[tuple], counts: np.ndarray, sequences: int) -> Plan:
    """Cut the rows at every rank where a row of the same length starts or ends, so that rows of a
    length cover the same runs of ranks."""
    edges = defaultdict(set)
    for length, lo, n, *_ in rows:
        edges[length] |= {lo, lo + n}
    sorted_edges = {k: sorted(v) for k, v in edges.items()}
    out = []
    for length, lo, n, part, size, base, offset in rows:
        e = sorted_edges[length]
        for at in e[bisect.bisect_left(e, lo) : bisect.bisect_left(e, lo + n)]:
            out.append((length, at, part, size, base + at - lo, offset))
    out.sort()
    table = np.array(out, np.int64).reshape(-1, 6)
    return Plan(*table.T, sequences)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Full windows and one remainder of each document's ids (with the end id), as bytes."""
    tokenizer = tokenizer or default_path()

    def cut(batches):
        encode = encoder(tokenizer)
        width = encode.dtype.itemsize
        end = np.asarray([END_ID], encode.dtype).tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // width
                for start in range(0, n, window):
                    piece = ids[start * width : (start + window) * width]
                    rows.append((doc_id, start, len(piece) // width, n, width == 4, piece))
            doc, start, length, n, wide, piece = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (doc, start, length, n)), pa.array(wide, pa.bool_()), pa.array(piece, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "wide", "ids"],
            )

    return keyed_texts(docs).mapInArrow(cut, PIECES_SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Every id of every document in exactly one piece, pieces in sequences of at most ``window`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (32 bits each).
    All sequences are full but for the last ids of the corpus, whose lengths are powers of two. A null
    text is empty (its end id only); a null doc_id is kept; rows of one id are packed each for itself, a very
    long text is many pieces; an empty table gives no row. Columns besides doc_id and text are not looked at.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(BUCKETS)).cast("int")
    pieces = materialise(token_pieces(docs, tokenizer, window).withColumn("bucket", bucket), "pieces")
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most ``window`` rows, whatever the size of the corpus.
    counts = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = pieces.sparkSession.sparkContext.broadcast(make_plan(counts, window))

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "bucket"])
        .select("doc_id", "start", "length", "doc_tokens", "wide", (F.col("first") + F.col("rank")).alias("rank"), "ids")
    )

    def put(batches):
        p = plan.value
        keys = p.length << 44 | p.lo
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            run = keys[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            first, last = np.searchsorted(keys, run, "left"), np.searchsorted(keys, run, "right")
            rows = []
            for i, (doc, start, _, n, wide, r, ids) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                ids = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                for j in range(first[i], last[i]):
                    a = int(p.part[j])
                    part = ids[a : a + int(p.size[j])].tobytes()
                    rows.append((doc, start + a, len(part) // 4, zlib.crc32(part), n, int(p.base[j]) + r - int(p.lo[j]), int(p.offset[j]), part))
            *whole, parts = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in whole), pa.array(parts, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return ranked.mapInArrow(put, PLACED_SCHEMA)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order and the joined ids; a sequence holds at most a window of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return (
        placed.groupBy("sequence_id").agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
            F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"))).alias("pieces"),
            F.concat(F.lit(b""), F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))).alias("ids"),
        )
    )
