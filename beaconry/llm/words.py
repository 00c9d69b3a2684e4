"""Words of texts as 64-bit hashes, for the operators that compare hashed words."""

from __future__ import annotations

import numpy as np
import xxhash

from beaconry.llm.common import RecentMap

#: ASCII signs and blanks part words; letters, digits and every byte beyond ASCII make them.
_BREAKS = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))
_HASHES = RecentMap(lambda words: [xxhash.xxh64_intdigest(w) or 1 for w in words], 100_000)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the lower-cased texts in order; a hash is never 0."""
    words, sizes = [], []
    for t in texts:
        w = t.lower().encode().translate(_BREAKS).split()
        words += w
        sizes.append(len(w))
    return np.repeat(np.arange(len(texts)), sizes), np.array(_HASHES.find(words), np.uint64)
