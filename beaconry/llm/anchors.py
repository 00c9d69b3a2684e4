"""Content-defined anchors: which stretches of texts can hold a repeated string of a given length.

Of every window of ``length`` bytes the ``GRAM``-byte string with the least hash (the leftmost of equals) is
its anchor. Equal windows have equal anchors at equal places, so repeats only need to be looked
for among windows with the same anchor. Windows that follow one another mostly share their anchor; such a
run is one row.
"""

from __future__ import annotations

import numpy as np

GRAM = 48
_RNG = np.random.default_rng(20240229)
#: Random numbers for bytes, and odd bases, of two independent polynomial hashes modulo 2**64.
_BYTES = _RNG.integers(1, 2**63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hash of any stretch of a byte array from sums of its prefixes."""

    def __init__(self, text: np.ndarray, which: int):
        n = len(text)
        self.sums = np.zeros(n + 1, np.uint64)
        powers = np.full(n, _BASES[which], np.uint64)
        if n:
            powers[0] = 1
        np.cumsum(_BYTES[which][text] * np.multiply.accumulate(powers), out=self.sums[1:])
        back = np.full(n + 1, _inverse(_BASES[which]), np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _final((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, begin, windows, anchor, content) of every run: the windows begin at ``begin`` and the places that
    follow; anchor is the hash of their common anchor and its place in the run, content that of all their bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(text) < length:
        return empty
    with np.errstate(over="ignore"):
        first = Hashes(text, 0)
        places = np.arange(len(text) - GRAM + 1)
        gram = first.of(places, places + GRAM)
        # Least hash of each window and where it stands: windows of doubling width, the left one wins ties.
        value, at, width, wanted = gram, places, 1, length - GRAM + 1
        while width < wanted:
            step = min(width, wanted - width)
            right = value[step:] < value[: len(value) - step]
            value = np.where(right, value[step:], value[: len(value) - step])
            at = np.where(right, at[step:], at[: len(at) - step])
            width += step
        doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
        inside = starts[doc] + np.arange(len(doc)) - np.repeat(
            np.concatenate([[0], np.cumsum(np.maximum(sizes - length + 1, 0))])[:-1], np.maximum(sizes - length + 1, 0)
        )
        if not len(doc):
            return empty
        anchor = at[inside]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        head = np.flatnonzero(new)
        windows = np.diff(np.append(head, len(doc)))
        begin, place = inside[head], anchor[head]
        content = Hashes(text, 1).of(begin, begin + windows + length - 1)
        content = _final(content ^ (place - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return doc[head], begin - starts[doc[head]], windows, gram[place], content
