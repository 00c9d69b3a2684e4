"""Token ids, record files and packing against the tokenizers library itself."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from beaconry.llm import packing, records
from beaconry.llm.tokens import Encoder, default_path

ODD = [
    "a", "b", "Word", " ", "  ", "\n", "\t", ",", ".", "'s", "'", "é", "ß", "1", "23", "²", "½", "_", "—", "\xa0", " ",
    "\x1c", "\0", "%%%", "中", "😀", "<|endoftext|>", "\r\n", "​", "İ", "'ll", "Á",
]
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("start", T.StringType()), T.StructField("ids", T.StringType()),
])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def odd_docs(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(6_000))
    rows = [(3, "three words here", "x", None), (1, None, None, "y"), (None, "no id", "x", "y"), (2, "", None, None),
            (3, "three words here", "x", None), (3, "another text", None, None), (7, long, None, None)]
    rows += [(n, " ".join(rng.choices(["alpha", "beta", "gamma"], k=n % 97)), None, None) for n in range(10, 200)]
    return rows, spark.createDataFrame(rows, DOCS)


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_library(library):
    rng = random.Random(1)
    texts = ["", "\n", " ", "."] + ["".join(rng.choices(ODD, k=rng.randint(1, 14))) for _ in range(3_000)]
    encode = Encoder(default_path(), 300)
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in part]
        assert encode.encode(part) == want


def test_added_tokens_are_ids_of_their_own(library):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "plain", "<|endoftext|><|endoftext|> x\n", "<|endoftext|"]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in Encoder(default_path()).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [64, 50256, 65]


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    got = Encoder(path).encode(["Some text, here", ""])
    assert got == [np.array(other.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in ("Some text, here", "")]


def test_records_round_trip(spark, tmp_path, library):
    rows, docs = odd_docs(spark)
    records.write_token_files(docs, str(tmp_path / "set"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in records.read_token_files(spark, str(tmp_path / "set")).collect())
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    want = sorted(((r[0], ids_of(library, r[1]).tobytes()) for r in rows), key=str)
    assert sorted(((g[1], g[4]) for g in got), key=str) == want
    assert all(g[3] == zlib.crc32(g[4]) and 4 * g[2] == len(g[4]) for g in got)


def test_index_gives_single_records(spark, tmp_path, library):
    rows, docs = odd_docs(spark)
    row = records.write_token_files(docs, str(tmp_path / "set")).filter("doc_id = 7").first()
    with open(row["file"].removeprefix("file://"), "rb") as f:
        f.seek(row["offset"])
        ((doc_id, ids),) = records.read_frames(io.BytesIO(f.read(row["size"])))
    assert doc_id == 7 and ids.astype("<u4").tobytes() == ids_of(library, rows[6][1]).tobytes()


def test_damage_is_found_and_empty_tables_work(spark, tmp_path):
    good = records.frame(1, b"\x01\x02", False)
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.read_frames(io.BytesIO(bytes(bad))))
    empty = spark.createDataFrame([], DOCS)
    records.write_token_files(empty, str(tmp_path / "none"))
    assert records.read_token_files(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("kind", ["many", "one length", "few", "none"])
def test_plan_places_every_id_once(kind):
    rng = np.random.default_rng(4)
    counts = np.zeros(1025, np.int64)
    if kind == "many":
        counts[1:1024] = rng.integers(0, 400, 1023)
        counts[700], counts[1024] = 200_000, 5_000
    elif kind == "one length":
        counts[700] = 1_001
    elif kind == "few":
        counts[[3, 900]] = 1, 2
    plan = packing.make_plan(counts)
    total = int((counts * np.arange(1025)).sum())
    filled = np.zeros(plan.sequences, np.int64)
    for length in np.flatnonzero(counts):
        at = np.flatnonzero(plan.length == length)
        los = np.unique(plan.lo[at])
        for lo, hi in zip(los, [*los[1:], counts[length]]):
            own = at[plan.lo[at] == lo]
            own = own[np.argsort(plan.part[own])]
            assert np.array_equal(plan.part[own], np.concatenate([[0], np.cumsum(plan.size[own])[:-1]])) and plan.size[own].sum() == length
            for j in own:
                filled[plan.base[j] : plan.base[j] + hi - lo] += plan.size[j]
    assert filled.sum() == total and filled.max(initial=0) <= 1024
    short = filled[filled < 1024]
    assert all(n & (n - 1) == 0 for n in short.tolist()) and short.sum() < 1024


def test_pack_keeps_every_id(spark, library):
    rows, docs = odd_docs(spark)
    placed = packing.pack(docs)
    got = [r.asDict() for r in placed.collect()]
    want = sorted(((r[0], ids_of(library, r[1]).tobytes()) for r in rows), key=str)
    by_doc = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    whole = {7: None, None: None, 1: None, 2: None}
    for doc in whole:
        parts = sorted(by_doc[doc], key=lambda r: r["start"])
        assert (doc, b"".join(bytes(p["ids"]) for p in parts)) in want
        assert all(p["doc_tokens"] == sum(q["length"] for q in parts) for p in parts)
    assert sum(r["length"] for r in got) == sum(len(x) // 4 for _, x in want)
    for r in packing.sequences(placed).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= 1024
        assert [p["offset"] for p in r["pieces"]] == [0, *np.cumsum([p["length"] for p in r["pieces"]])[:-1].tolist()]
