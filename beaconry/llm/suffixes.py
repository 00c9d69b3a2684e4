"""Suffix order and common prefixes of a text by induced sorting with disk-backed priority queues.

Suffixes are sorted from those at local minima: these carry (place, common prefix) tuples into one queue per first
character, from which larger suffixes are taken in order, and then from the other side the smaller ones.
A queue is read in the order of its insertions, so all queues together are one priority queue by
(character, insertion); what exceeds a bound of memory waits in files. The minima themselves are sorted by the
same induction over their pieces, and where pieces repeat, by doubling the names of the pieces.

All work on a bucket is done for whole blocks of tuples at a time.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict

import numpy as np

_RNG = np.random.default_rng(77)
_FAR = np.iinfo(np.int32).max


class BucketQueues:
    """Tuples (place, common prefix with the tuple before) by character, first in first out; long ones on disk."""

    def __init__(self, most_rows: int):
        self.most, self.rows = most_rows, 0
        self.held: dict[int, list[np.ndarray]] = defaultdict(list)
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files: dict[int, str] = {}

    def push(self, char: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.held[char].append(np.stack([places.astype(np.int32), prefixes.astype(np.int32)]))
        self.rows += len(places)
        if self.rows > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffix-queues-")
        for char, blocks in self.held.items():
            self.files[char] = os.path.join(self.folder.name, str(char))
            with open(self.files[char], "ab") as f:
                for block in blocks:
                    f.write(np.ascontiguousarray(block.T).tobytes())
        self.held.clear()
        self.rows = 0

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Everything that now waits under ``char``."""
        blocks = []
        if char in self.files:
            path = self.files.pop(char)
            blocks.append(np.fromfile(path, np.int32).reshape(-1, 2).T)
            os.remove(path)
        held = self.held.pop(char, [])
        self.rows -= sum(b.shape[1] for b in held)
        blocks += held
        return tuple(np.concatenate(blocks, 1)) if blocks else None

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class _Carrier:
    """Sends the tuples of predecessors into the queues and keeps the least common prefix since the last one."""

    def __init__(self, text, small, chars: int, most_rows: int):
        self.text, self.small = text, small
        self.queues = BucketQueues(most_rows)
        self.least = np.full(chars, _FAR, np.int64)
        self.used = np.zeros(chars, bool)

    def send(self, places: np.ndarray, prefixes: np.ndarray, small: bool) -> None:
        before = places - 1
        at = np.flatnonzero((places > 0) & (self.small[before] == small))
        chars = self.text[before[at]]
        order = np.argsort(chars, kind="stable")
        at, chars = at[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        old = self.least.copy()
        np.minimum(self.least, prefixes.min(), out=self.least)
        for own in np.split(at, cuts) if len(at) else []:
            char = int(self.text[before[own[0]]])
            least = np.minimum.reduceat(prefixes[: own[-1] + 1], np.concatenate([[0], own[:-1] + 1]))
            least[0] = min(least[0], old[char])
            found = least + 1
            if not self.used[char]:
                self.used[char], found[0] = True, 0
            self.queues.push(char, before[own], found)
            self.least[char] = prefixes[own[-1] + 1 :].min(initial=_FAR)


def _induce(text, small, run, chars: int, minima, prefixes, most_rows: int):
    """All suffixes and common prefixes from the sorted minima. run: how often a place's character goes on."""
    cuts = np.searchsorted(text[minima], np.arange(chars + 1))
    large: list = [None] * chars
    carrier = _Carrier(text, small, chars, most_rows)
    for c in range(chars):
        blocks = []
        while (block := carrier.queues.pop(c)) is not None:
            blocks.append(block)
            carrier.send(*block, small=False)
        if blocks:
            large[c] = tuple(np.concatenate(x) for x in zip(*blocks))
        if cuts[c] < cuts[c + 1]:
            places, common = minima[cuts[c] : cuts[c + 1]], prefixes[cuts[c] : cuts[c + 1]].copy()
            common[0] = min(run[large[c][0][-1]], run[places[0]]) if blocks else 0
            carrier.send(places, common, small=False)
    carrier.queues.close()

    order, common_all = [], []
    carrier = _Carrier(text, small, chars, most_rows)
    for c in range(chars - 1, -1, -1):
        blocks = []
        while (block := carrier.queues.pop(c)) is not None:
            blocks.append(block)
            carrier.send(*block, small=True)
        if c == 0:
            blocks.append((np.array([len(text) - 1], np.int32), np.zeros(1, np.int32)))
        down = tuple(np.concatenate(x) for x in zip(*blocks)) if blocks else None
        if large[c] is not None:
            places, common = large[c]
            back = np.concatenate([[0], common[:0:-1]])
            if down is not None:
                back[0] = min(run[places[-1]], run[down[0][-1]])
            carrier.send(places[::-1], back, small=True)
        if down is not None:
            edge = min(run[large[c][0][-1]], run[down[0][-1]]) if large[c] is not None else 0
            order.append(down[0][::-1])
            common_all.append(np.concatenate([[edge], down[1][:0:-1]]))
        if large[c] is not None:
            order.append(large[c][0])
            common_all.append(large[c][1])
    carrier.queues.close()
    return np.concatenate(order[::-1]), np.concatenate(common_all[::-1])


def _hash_sums(text: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0xD1342543DE82EF95)
    values = _RNG.integers(1, 2**62, chars, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(text)
    with np.errstate(over="ignore"):
        powers, back = np.full(n, base, np.uint64), np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        powers[0] = back[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[text] * np.multiply.accumulate(powers))])
        return sums, np.multiply.accumulate(back)


def suffix_order(text: np.ndarray, chars: int, depth: int, most_rows: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and the common prefix of each with the one before.

    ``text`` holds numbers below ``chars`` and ends with its only 0. The order is exact for the first ``depth``
    characters; common prefixes are exact up to ``depth`` and not less than it beyond.
    """
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    at = np.arange(n - 1, dtype=np.int32)
    nxt = change.astype(np.int32)[np.searchsorted(change, at)]
    small = np.append(text[nxt] < text[nxt + 1], True)
    run = np.append(nxt - at + 1, np.int32(1))
    del change, at, nxt
    places = np.flatnonzero(small[1:] & ~small[:-1]) + 1

    first = places[np.argsort(text[places], kind="stable")]
    order, _ = _induce(text, small, run, chars, first, np.zeros(len(first), np.int64), most_rows)
    is_minimum = np.zeros(n, bool)
    is_minimum[places] = True
    ordered = order[is_minimum[order]]
    del first, order, is_minimum

    sums, back = _hash_sums(text, chars)
    end = np.append(places[1:] + 1, n)
    which = np.searchsorted(places, ordered)
    with np.errstate(over="ignore"):
        content = (sums[end[which]] - sums[ordered]) * back[ordered]
    new = (content[1:] != content[:-1]) | (np.diff((end - places)[which]) != 0)
    name = np.zeros(len(places), np.int64)
    name[which] = np.concatenate([[0], np.cumsum(new)])
    # Places are two apart at least, so h names tell 2 h characters.
    h = 1
    while name.max() + 1 < len(places) and 2 * h <= depth + 2:
        behind = np.concatenate([name[h:] + 1, np.zeros(min(h, len(name)), np.int64)])[: len(name)]
        name = np.unique(name * (len(places) + 1) + behind, return_inverse=True)[1]
        h *= 2
    ordered = places[np.argsort(name, kind="stable")]

    low, high = np.zeros(len(ordered) - 1, np.int64), np.minimum(depth, n - np.maximum(ordered[1:], ordered[:-1]))
    a, b = ordered[:-1], ordered[1:]
    with np.errstate(over="ignore"):
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = (sums[a + middle] - sums[a]) * back[a] == (sums[b + middle] - sums[b]) * back[b]
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    del sums, back, name, high
    return _induce(text, small, run, chars, ordered, np.concatenate([[0], low]), most_rows)
