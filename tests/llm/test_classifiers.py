"""Toxicity and language on small labelled tables; scores from the text alone."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import types as T

from beaconry.llm import language, toxicity

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("score", T.StringType()), T.StructField("slots", T.StringType()),
])
LABELS = "doc_id bigint, toxic int"


def toxic_rows():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for n in range(600):
        text = rng.choices(words, k=rng.randint(5, 80))
        bad = n % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vilename", "nastyword", "crudeterm"]))
        rows.append((n, " ".join(text), None, None, None, None))
        labels.append((n, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    odd = [(900, None, None, "l", None, None), (901, "", None, None, None, None), (None, "nastyword vilename crudeterm", None, None, None, None), (0, rows[0][1], None, None, None, None), (902, "wort " * 50_000, None, None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    table = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 0)], LABELS)
    got = [r.asDict() for r in toxicity.toxicity(docs, table).collect()]
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (900, 901)}
    assert len(empty) == 1 and max(empty) < 0.5
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1
    kept = toxicity.accepted(docs, toxicity.fit(docs, table))
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["predicted"] for r in got)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None, None, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.5]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_features_are_words_pairs_and_skips():
    row, slot = toxicity.features(["one two three", "", "One, TWO"])
    assert np.bincount(row, minlength=3).tolist() == [3 + 2 + 1, 0, 2 + 1]
    own = [set(slot[row == i]) for i in (0, 2)]
    assert own[1] < own[0]


def test_forward_sums_all_segmentations():
    pieces = language.pieces_of(language.default_path())
    rng = np.random.default_rng(4)
    table = rng.random((2, pieces.count))
    table /= table.sum(1, keepdims=True)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    words = [b"the", b"a", b"strasse", "größe".encode()]
    for which, text in language.by_length(words):
        total = language.forward(pieces.lattice(text), language.scaled(table, pieces))[:, -1]
        for i, own in zip(which, total):
            full = b" " + words[i]
            want = np.zeros(2)
            for cuts in itertools.product([0, 1], repeat=len(full) - 1):
                ends = [j + 1 for j, c in enumerate(cuts) if c] + [len(full)]
                parts = [full[a:b] for a, b in zip([0, *ends], ends)]
                if all(p in number and len(p) <= language.LONGEST_PIECE for p in parts):
                    want += np.prod([table[:, number[p]] for p in parts], axis=0)
            assert np.allclose(own / language.PER_BYTE ** len(full), want, rtol=1e-9)


def test_language_on_held_out_rows(spark):
    rng = random.Random(5)
    stems = {"aa": ["kelo", "tuli", "vesi", "maa"], "bb": ["strick", "grund", "schaft", "zeit"], "cc": ["cione", "mento", "zzare", "glia"]}
    rows = []
    for n in range(400):
        lang = sorted(stems)[n % 3]
        words = ["".join(rng.choices(stems[lang], k=2)) for _ in range(rng.randint(3, 30))]
        rows.append((n, " ".join(words), None if n % 50 == 0 else lang, None, None, None))
    odd = [(900, None, "aa", None, None, None), (901, "12 34 !", "bb", None, None, None), (902, "", None, None, None, None),
           (None, "kelotuli vesimaa tulikelo", "bb", None, None, None), (903, "kelo" * 30_000, None, None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = {r["doc_id"]: r for r in language.language(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for n, r in got.items() if r["held_out"] and n < 600]
    assert all(r["held_out"] == (n is not None and zlib.crc32(str(n).encode()) % 4 == 2) for n, r in got.items())
    assert sum(r["lang_pred"] == sorted(stems)[r["doc_id"] % 3] for r in held) / len(held) > 0.97
    assert all(got[n]["lang_pred"] == "und" and got[n]["score"] == 0 for n in (900, 901, 902))
    assert got[None]["lang_pred"] == got[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    unnamed = language.language(docs.filter("lang is null")).collect()
    assert {(r["lang_pred"], r["score"]) for r in unnamed} == {("und", 0.0)}
    assert language.language(docs.limit(0)).count() == 0


def test_long_stretches_are_summed_over_all_cuts():
    pieces = language.pieces_of(language.default_path())
    rng = np.random.default_rng(4)
    table = rng.dirichlet(np.ones(pieces.count), 3)
    scorer = language.Scorer(language.default_path(), table)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    thai = "ภาษาไทยเป็นภาษาที่มีการใช้กันอย่างแพร่หลายในประเทศไทยและไม่มีช่องว่างระหว่างคำ"
    stretches = [thai.encode(), (thai * 40).encode(), b"x" * 41, ("ж" * 3_000).encode()]
    got = scorer.score([s.decode() for s in stretches] + [thai + " " + "x" * 41, ""])
    for stretch, found in zip(stretches, got):
        text, sums = b" " + stretch, [np.zeros(3)]
        for end in range(1, len(text) + 1):
            terms = [
                sums[end - k] + np.log(table[:, number[text[end - k : end]]])
                for k in range(1, min(end, language.LONGEST_PIECE) + 1) if text[end - k : end] in number
            ]
            sums.append(np.logaddexp.reduce(terms))
        assert np.allclose(found, sums[-1], rtol=1e-9)
    assert np.allclose(got[4], got[0] + got[2]) and not got[5].any()
    parts = language.parts_of(thai.encode())
    assert b"".join(parts).decode() == thai and all(p.decode() and len(p) <= language.LONGEST_WORD for p in parts)
