"""Token ids of whole texts with a public tokenizer file and the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import accumulate, chain

import numpy as np
import regex

from beaconry.llm.common import RecentMap

#: Fixed value: the split rule that byte-level files of this kind name by ``use_regex``.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes by themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: The same rule for texts whose only numbers are decimal digits; faster in the standard library.
_DECIMAL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
#: Kinds of ASCII characters: w white space, _ other white space or line drawing, s sign, a the rest.
_KINDS = bytes(
    ord("w" if b in (10, 32) else "_" if b in (0, 9, 11, 12, 13, 28, 29, 30, 31, 95) else "s" if b < 128 and not chr(b).isalnum() else "a")
    for b in range(256)
)


class Encoder:
    """Ids as little-endian bytes: 16 bits each where the vocabulary allows it, else 32.

    For byte-level BPE files a text is first cut into units of the file's split rule, so the ids of a text
    are those of its units in a row. Units are remembered (a bounded memo), and the unknown ones of many
    texts go through the library's BPE model together. Texts without neighbouring signs or blanks
    are cut by plain replacement, others by the rule itself. Texts that hold the string of an added token, such
    as a special one, and all texts of other kinds of files go whole through the library with its defaults.
    """

    def __init__(self, path: str, memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_parts = (
            spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
        )
        if self.by_parts:
            self.letters = byte_letters()
            del self.letters[10]
            self.split = regex.compile(BYTE_LEVEL_SPLIT).findall
            self.split_decimal = re.compile(_DECIMAL_SPLIT).findall
            self.odd = re.compile(r"[^\w\x00-\x7f]").search
            self.parts = RecentMap(self._parts, memo)

    def _library(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _units(self, text: str) -> list[str]:
        decimal = all(c.isalpha() or c.isdecimal() for c in set(text) if c.isalnum())
        return (self.split_decimal if decimal and not re.search("[\x1c-\x1f]", text) else self.split)(text)

    def _cut(self, text: str) -> list[str]:
        """Parts of a text, none of which shares a unit with another."""
        kinds = text.encode().translate(_KINDS)
        if b"ws" in kinds or b"ss" in kinds or b"ww" in kinds or b"_" in kinds or not text.isascii() and self.odd(text):
            return self._units(text)
        return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0").split("\0")

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Each distinct unit of the parts goes through the model once."""
        plain = [p for p in parts if p and not p[-1].isspace() and "\n" not in p]
        units = list(set(self._units("\n".join(plain))).difference(["\n"]))
        written = "\n".join(units).encode().decode("latin-1").translate(self.letters).split("\n")
        bpe, code = self.whole.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        known = {u: array(code, [t.id for t in bpe(w)]).tobytes() for u, w in zip(units, written)}
        out = list(map(known.get, parts))
        for i, found in enumerate(out):
            if found is None:
                out[i] = b"".join([known.get(u) or self._library(u) for u in self._units(parts[i])])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``self.dtype``."""
        if not self.by_parts:
            return [np.asarray(e.ids, self.dtype).tobytes() for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        whole = {i: self._library(t) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        cut = [[] if i in whole else self._cut(t) for i, t in enumerate(texts)]
        found = self.parts.find(list(chain.from_iterable(cut)))
        ends = list(accumulate(map(len, cut), initial=0))
        return [whole[i] if i in whole else b"".join(found[ends[i] : ends[i + 1]]) for i in range(len(cut))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file: the memo lives on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
