"""License notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice of n characters may have k edits. Cut into k + 1 pieces, one piece at least is unharmed wherever
the notice stands, so an automaton of all pieces finds every place to look at; there the fuzzy
matching of the ``regex`` library decides and gives edits and span. Texts are compared as their
lower-cased words, one blank between.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import keyed_texts, slices

#: Phrases whose exact places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Usual short notices, as words, with their labels.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "boost"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "notices array<struct<label: string, edits: int, similarity: double, first_word: long, last_word: long>>"
)
_ARROW_NOTICES = pa.list_(pa.struct([
    ("label", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
]))
_BREAKS = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))


def edits_allowed(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def pieces(notice: str) -> list[tuple[str, int]]:
    """k + 1 pieces with their places in the notice, as equal in length as can be."""
    parts = edits_allowed(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.phrases = {f" {p} ": (label, p.count(" ")) for p, label in phrases.items()}
        self.notices = notices
        self.patterns = [
            regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits_allowed(text)}}}") for text, _ in notices
        ]
        seeds = defaultdict(list)
        for number, (text, _) in enumerate(notices):
            for piece, at in pieces(text):
                seeds[piece].append((number, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """(place of the blank before, words behind the first, label) of every phrase; text has blanks at both ends."""
        out = []
        for phrase, (label, more) in self.phrases.items():
            at = text.find(phrase)
            while at >= 0:
                out.append((at, more, label))
                at = text.find(phrase, at + 1)
        return out

    def fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, edits, begin, end) of the matches, without blanks at their ends.

        Each candidate place is searched for itself. A match goes only where a better one covers all of it, a
        notice with the same label and no more edits does, or the same notice stands there with no more edits.
        """
        places = defaultdict(set)
        for end, (length, where) in self.seeds.iter(text):
            for number, at in where:
                places[number].add(end - length + 1 - at)
        out = set()
        for number, begins in places.items():
            wanted = self.notices[number][0]
            k = edits_allowed(wanted)
            for place in begins:
                # Too short a stretch for two notices one behind the other, so the best match is that of this place.
                m = self.patterns[number].search(text, max(0, place - k), min(len(text), place + len(wanted) + k))
                if m:
                    part = m.group()
                    begin, end = m.start() + len(part) - len(part.lstrip(" ")), m.end() - len(part) + len(part.rstrip(" "))
                    out.add((sum(m.fuzzy_counts), begin - end, begin, end, number))
        # Only matches that overlap are compared: groups of them in the order of the text.
        kept: list[tuple] = []
        group: list[tuple] = []
        reach = 0
        for match in sorted(out, key=lambda m: m[2:]):
            if match[2] >= reach:
                kept += self._best(group)
                group = []
            group.append(match)
            reach = max(reach, match[3])
        return kept + self._best(group)

    def _best(self, matches: list[tuple]) -> list[tuple[int, int, int, int]]:
        kept: list[tuple] = []
        for edits, _, begin, end, number in sorted(matches):
            label = self.notices[number][1]
            if not any(
                (a <= begin and end <= b and (e < edits or self.notices[n][1] == label)) or (n == number and a < end and begin < b)
                for n, e, a, b in kept
            ):
                kept.append((number, edits, begin, end))
        return kept

    def scan(self, text: str) -> tuple:
        words = text.encode().lower().translate(_BREAKS).split()
        joined = " " + b" ".join(words).decode("latin-1") + " "
        base = self.base(joined)
        # Places of the blanks before the words, in order; that before word i is the i-th.
        blanks = [0, *accumulate(len(w) + 1 for w in words)]
        starts = [bisect_left(blanks, at) for at, _, _ in base]
        notices = []
        for number, edits, begin, end in self.fuzzy(joined):
            wanted, label = self.notices[number]
            first = bisect_left(blanks, begin) - 1
            notices.append({
                "label": label, "edits": edits, "similarity": 1 - edits / len(wanted),
                "first_word": first, "last_word": bisect_left(blanks, end) - 1,
            })
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None), sorted({x[2] for x in base}),
            sorted(notices, key=lambda n: (n["first_word"], n["label"], n["edits"], n["last_word"])),
        )


_SCANNERS: list[Scanner] = []


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, exact phrases (how many, first and last start, labels) and all fuzzy notices.

    A null or empty text has no words and no notice; repeated rows are scanned each for itself, a null doc_id is
    kept, an empty table gives no row. Columns besides doc_id and text are not looked at.
    """

    def apply(batches):
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        for batch in slices(batches):
            n, base, first, last, labels, notices = zip(*map(_SCANNERS[0].scan, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, base, first, last)),
                 pa.array(labels, pa.list_(pa.string())), pa.array(notices, _ARROW_NOTICES)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "notices"],
            )

    return keyed_texts(docs).mapInArrow(apply, SCHEMA)


def labelled(scanned: DataFrame) -> DataFrame:
    """Labels as sorted, comma-joined strings, and the best similarity (1 for an exact phrase, 0 without any)."""
    found = F.transform("notices", lambda n: n["label"])
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["similarity"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", found))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
        "notices",
    )
