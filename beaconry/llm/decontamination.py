"""Documents that hold a benchmark item, verbatim or with up to a fifth of its words edited.

A CGK walk turns the pieces of an item, its stretches of ``PIECE`` words, and all windows of as many words of a
text into strings in which few edits become few differing positions. Sampled positions of a walk are a key; walks
are repeated as often as a simulation says for the item's length and allowed edits, until items are met with
probability ``RECALL``. Where a window shares a key and most words with a piece, the whole item is aligned exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import keyed_texts, mix, slices
from beaconry.llm.words import hashed_words

SIMILARITY = 0.8
#: Words of a piece, positions of a walk that make a key, and the share of items with all edits allowed to be met.
PIECE, SAMPLED, RECALL = 6, 3, 0.999
#: Steps between these positions at least in whole pieces.
GAP = 3
#: Words of a piece that its window may lack, and walks at least where edits are allowed.
LACKING, LEAST_WALKS = 2, 4
#: Characters of items that go to the tasks at once; more items are searched in blocks.
BLOCK_CHARS = 8_000_000
#: Words of texts that walks go over at a time.
BLOCK_WORDS = 1 << 17
FOUND_SCHEMA = "doc_id long, item_id long, edits long, n_words long, first_word long, last_word long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def edits_allowed(n_words: int) -> int:
    return int(round((1 - SIMILARITY) * 10**6)) * n_words // 10**6


def piece_size(n_words: int) -> int:
    return min(n_words, PIECE)


def sampled_positions(size: int, walk_no: int) -> list[int]:
    """Positions of a walk over ``size`` words, which reaches the last word after twice as many steps as a rule.

    In whole pieces they lie ``GAP`` steps apart at least, as the walk often stays at a word and a key of one word tells little.
    """
    rng, more = np.random.default_rng(1000 * size + walk_no), GAP - 1 if size == PIECE else 0
    free = max(2 * size - 1 - more * (SAMPLED - 1), SAMPLED)
    return [p + more * i for i, p in enumerate(sorted(rng.choice(free, SAMPLED, replace=False).tolist()))]


def keys(words: np.ndarray, begins: np.ndarray, size: int, walk_no: int) -> np.ndarray:
    """The walk's key of each window of ``size`` words at ``begins``: its words at the sampled positions.

    At each step a bit of the word's hash decides whether the walk goes on to the next word; it stays at the last one.
    """
    positions = sampled_positions(size, walk_no)
    factor = np.uint64(int(mix(np.array([walk_no + 1], np.uint64), size)[0]) | 1)
    with np.errstate(over="ignore"):
        bits = (words * factor >> np.uint64(48)).astype(np.uint16)
        at, last = begins.astype(np.int32), (begins + (size - 1)).astype(np.int32)
        key = np.full(len(at), factor, np.uint64)
        for step in range(positions[-1] + 1):
            if step in positions:
                key = (key ^ words[at]) * _ODD
                key ^= key >> np.uint64(29)
            if step < positions[-1]:
                at += (bits[at] >> np.uint16(step)) & np.uint16(1)
                np.minimum(at, last, out=at)
        return key * _ODD


def alike(words: np.ndarray, at: np.ndarray, others: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows of ``size`` words at ``at`` hold most words of the pieces at ``begins`` of ``others``."""
    held = np.zeros(len(at), np.int64)
    for i in range(size):
        word, held_here = others[begins + i], np.zeros(len(at), bool)
        for j in range(size):
            held_here |= words[at + j] == word
        held += held_here
    return held >= min(size, max(size - LACKING, 2))


def edited(words: list, k: int, rng: np.random.Generator, even: bool) -> list:
    """``k`` words, at even distances or anywhere, replaced, left out, or with a new one in front."""
    out, n = [], len(words)
    first = int(rng.integers(n))
    where = {(i * n + first) // k % n for i in range(k)} if even else set(rng.choice(n, k, replace=False).tolist())
    for i, word in enumerate(words):
        if i in where:
            kind = rng.integers(3)
            out += [[-i - 1], [], [-i - 1, word]][kind]
        else:
            out.append(word)
    return out


@lru_cache(None)
def walks_needed(n_words: int) -> int:
    """Walks until ``RECALL`` of random items of so many words share a key with their copies at the allowed edits.

    Half of the copies have their edits at even distances, where no long stretch is left as it was.
    """
    k, size = edits_allowed(n_words), piece_size(n_words)
    if not k:
        return 1
    rng = np.random.default_rng(n_words)
    trials = max(200, 30_000 // n_words)
    own, copies, row, rows = [], [], [], []
    for t in range(trials):
        base = [t * 4 * n_words + i + 2 * n_words for i in range(n_words)]
        copy = [t * 4 * n_words if w < 0 else w for w in edited(base, k, rng, t % 2 == 0)]
        for text, words, of in ((base, own, row), (copy, copies, rows)):
            words += [*text, *range(10**9 + len(words), 10**9 + len(words) + PIECE)]
            of += [t] * len(text) + [-1] * PIECE
    own, copies = (mix(np.array(x, np.uint64), 1) for x in (own, copies))
    row, rows = np.array(row), np.array(rows)
    begins = np.flatnonzero((row >= 0) & (np.append(row[size - 1 :], [-1] * (size - 1)) == row))
    windows = np.flatnonzero(rows >= 0)
    met, walks = np.zeros(trials, bool), 0
    while met.mean() < RECALL or walks < LEAST_WALKS:
        key, other = keys(own, begins, size, walks), keys(copies, windows, size, walks)
        order = np.argsort(key, kind="stable")
        low, high = np.searchsorted(key[order], other), np.searchsorted(key[order], other, "right")
        hit = np.flatnonzero(high > low)
        piece = begins[order[low[hit]]]
        right = (row[piece] == rows[windows[hit]]) & alike(copies, windows[hit], own, piece, size)
        met[row[piece[right]]] = True
        walks += 1
    return walks


def length_class(n_words: int) -> int:
    """The length below 12 words, else its three leading bits: shorter items need no fewer walks."""
    drop = max(0, n_words.bit_length() - 3)
    return n_words if n_words < 12 else n_words >> drop << drop


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least word edits between the item and any stretch of each window, and that stretch (first, last).

    Of equally good stretches the one that ends first, and of these the longest, is given.
    """
    m, width = windows.shape
    cost = np.zeros((m, width + 1), np.int64)
    start = np.broadcast_to(np.arange(width + 1), (m, width + 1)).copy()
    place = np.arange(width + 1)
    for i, word in enumerate(item, 1):
        other = windows != word
        new, come = np.empty_like(cost), np.empty_like(start)
        new[:, 0], come[:, 0] = i, 0
        swap, drop = cost[:, :-1] + other, cost[:, 1:] + 1
        better = (swap < drop) | (swap == drop) & (start[:, :-1] <= start[:, 1:])
        new[:, 1:] = np.where(better, swap, drop)
        come[:, 1:] = np.where(better, start[:, :-1], start[:, 1:])
        # Words of the window without partner: the cheapest earlier place plus one for each word since.
        key = (new - place) * (width + 2) + come
        low = np.minimum.accumulate(key, 1)
        cost, start = low // (width + 2) + place, low % (width + 2)
    last = np.argmin(cost, 1)
    row = np.arange(m)
    return cost[row, last], start[row, last], last - 1


@dataclass
class Item:
    item_id: int
    words: np.ndarray


class Matcher:
    """Items prepared for the search; made once per worker."""

    def __init__(self, ids: list[int], texts: list[str]):
        row, hashes = hashed_words(texts)
        self.items = []
        for i, item_id in enumerate(ids):
            words = hashes[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
            if len(words):
                self.items.append(Item(item_id, words))
        self.known = [np.unique(x.words) for x in self.items]
        self.words = np.concatenate([x.words for x in self.items]) if self.items else np.zeros(0, np.uint64)
        self.ahead = np.cumsum([0, *(len(x.words) for x in self.items)])
        like: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for t, x in enumerate(self.items):
            n = len(x.words)
            like.setdefault((piece_size(n), walks_needed(length_class(n))), []).extend((t, at) for at in range(n - piece_size(n) + 1))
        #: (words of a piece, number of the walk), and the sorted keys of all pieces with their item and place.
        self.walks, table = set(), [[], [], []]
        for (size, walks), where in like.items():
            item, place = np.array(where, np.int64).T
            for walk_no in range(walks):
                self.walks.add((size, walk_no))
                for column, values in zip(table, (keys(self.words, self.ahead[item] + place, size, walk_no), item, place)):
                    column.append(values)
        key, item, place = (np.concatenate(c) for c in table) if self.walks else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order].astype(np.int32), place[order].astype(np.int32)
        bits = min(26, max(18, len(key).bit_length() + 4))
        self.shift, self.maybe = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.maybe[self.key >> self.shift] = True

    def candidates(self, row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, row, place where the item would begin), each once and sorted, of all windows that share a key with
        a piece. A place may lie before its document."""
        if not len(words):
            return (np.zeros(0, np.int64),) * 3
        # Zeros behind each document, so that windows at its end have all their words.
        begins = np.arange(len(words)) + row * PIECE
        padded = np.zeros(len(words) + (int(row[-1]) + 1) * PIECE, np.uint64)
        padded[begins] = words
        span = len(words) + len(self.words) + 1
        found = [np.zeros(0, np.int64)]
        for lo in range(0, len(words), BLOCK_WORDS):
            here = slice(lo, min(lo + BLOCK_WORDS, len(words)))
            ahead = int(begins[lo])
            own, part = padded[ahead : int(begins[here.stop - 1]) + PIECE + 1], begins[here] - ahead
            for size, walk_no in sorted(self.walks):
                key = keys(own, part, size, walk_no)
                hit = np.flatnonzero(self.maybe[key >> self.shift])
                low, high = np.searchsorted(self.key, key[hit]), np.searchsorted(self.key, key[hit], "right")
                # A key of very many items is met in parts.
                for some in np.array_split(np.arange(len(hit)), int((high - low).sum()) // 1_000_000 + 1):
                    n = high[some] - low[some]
                    entry = np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    at, item, place = np.repeat(hit[some], n), self.item[entry].astype(np.int64), self.place[entry]
                    near = alike(own, part[at], self.words, self.ahead[item] + place, size)
                    at, item, place = at[near] + lo, item[near], place[near]
                    found.append(np.unique((item * (int(row[-1]) + 1) + row[at]) * span + at - place + len(self.words)))
        line, first = np.divmod(np.unique(np.concatenate(found)), span)
        return *np.divmod(line, int(row[-1]) + 1), first - len(self.words)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item_id, edits, item's words, first and last word of the stretch): the best of each row and item."""
        row, words = hashed_words(texts)
        begins = np.searchsorted(row, np.arange(len(texts) + 1))
        found = self.candidates(row, words)
        best: dict[tuple[int, int], tuple] = {}
        if not len(found[0]):
            return []
        cuts = np.flatnonzero(np.diff(found[0])) + 1
        for t, doc, first in zip(*(np.split(x, cuts) for x in found)):
            if not len(t):
                continue
            item = self.items[t[0]]
            n, k = len(item.words), edits_allowed(len(item.words))
            for at in range(0, len(doc), 512):
                d, f = doc[at : at + 512], first[at : at + 512] - k
                windows = self._windows(words, begins, d, f, np.full(len(d), n + 2 * k))
                # A stretch with k edits has n - k words of the item at least.
                known = self.known[t[0]]
                near = known[np.minimum(np.searchsorted(known, windows), len(known) - 1)] == windows
                able = np.flatnonzero(near.sum(1) >= n - k)
                edits, a, b = align(item.words, windows[able])
                for i in np.flatnonzero(edits <= k):
                    own = int(f[able[i]]) - int(begins[d[able[i]]])
                    value = (int(edits[i]), own + int(a[i]), own + int(b[i]))
                    name = (int(d[able[i]]), int(t[0]))
                    best[name] = min(best.get(name, value), value)
        return [(d, self.items[t].item_id, e, len(self.items[t].words), a, b) for (d, t), (e, a, b) in sorted(best.items())]

    @staticmethod
    def _windows(words, begins, doc, first, width) -> np.ndarray:
        """Windows of ``width`` words each; 0 outside the document and behind a shorter window."""
        step = np.arange(int(width.max()))
        at = first[:, None] + step
        inside = (at >= begins[doc][:, None]) & (at < begins[doc + 1][:, None]) & (step < width[:, None])
        return np.where(inside, words[np.where(inside, at, 0)], np.uint64(0))


_MATCHERS: dict[int, Matcher] = {}


def _matcher(sent) -> Matcher:
    if sent.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[sent.id] = Matcher(*sent.value)
    return _MATCHERS[sent.id]


class _Sent:
    """Items of one block with a name of their own, as the tasks get them."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> list[_Sent]:
    """The items in blocks of about ``block_chars`` characters; texts that are null have no words and never match."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    named = named.filter("item_id is not null and text is not null")
    chars = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    out = []
    for b in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        out.append(_Sent(named.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))))
    return out


def contamination(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, edits, n_words (of the item), and the first
    and last word of the best stretch (words counted from 0 in the lower-cased text).

    A match has at most a fifth of the item's words edited, so items below five words match verbatim. Null texts have
    no words, null item ids and items without words never match, a null doc_id is kept, repeated rows are searched each for
    itself; of equally good stretches the first is given. Empty tables give no row, and columns besides doc_id,
    item_id and text are not looked at.
    """
    out = None
    for sent in item_blocks(items, block_chars):
        part = keyed_texts(docs).mapInArrow(_search(sent), FOUND_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _search(sent: _Sent):
    def search(batches):
        for batch in slices(batches):
            found = _matcher(sent).find(batch.column(1).to_pylist())
            if found:
                row, *rest = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in rest)],
                    ["doc_id", "item_id", "edits", "n_words", "first_word", "last_word"],
                )

    return search


def clean(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for sent in item_blocks(items, block_chars):
        docs = docs.filter(~_holds(sent)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs


def _holds(sent: _Sent):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], text=0):
            hit = {f[0] for f in _matcher(sent).find(part.column(0).to_pylist())}
            out += [i in hit for i in range(part.num_rows)]
        return pa.array(out, pa.bool_())

    return holds
