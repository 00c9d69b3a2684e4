"""Quality rules, vector codes and source divergence against plain loops and their SQL twins."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from beaconry.llm import codebooks, divergence, quality
from beaconry.llm.oracles import ORACLES
from beaconry.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_quality", "op12_codes", "op13_divergence"])
def test_query_equals_its_sql_twin(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    answer = duck.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    want = Counter(answer.fetchall())
    result = QUERIES[name](spark, SF_DIR)
    assert sorted(result.columns) == sorted(names)
    assert Counter(tuple(r) for r in result.select(*names).collect()) == want


def texts(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash", 1) for r in rows],
        "doc_id long, text string, lang string, source string, words string, n long",
    )


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))
    return counts, len(words) < 50 or 100 * len(marked) > 50 * len(words), len(lines)


ODD_TEXTS = [
    None, "", " \n\t", "\n\n\n", "one", "a b", "a b c", "a a a a a", "a b c a b c", "x\ny\nx\n \n \ny", "x\rx\x0bx\x0cx",
    "# * $ % & | < > ## é𝕏 ﬀ", "word word " * 30, "a b c d " * 40, "line of words\n" * 30, "Ωδ " * 60, "x" * 100_000,
]


def test_counts_equal_plain_loops_on_odd_texts(spark):
    docs = texts(spark, [(i, t, "en", None if i % 2 else "s") for i, t in enumerate(ODD_TEXTS)])
    for r in quality.counts(docs).collect():
        counts, failed, lines = plain_counts(ODD_TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert (r.base_failed, r.n_lines) == (failed, lines)


def plain_bucket(v):
    bits = max(0, v.bit_length() - 6)
    return v >> bits << bits


def plain_kept(rows):
    """``rows`` of (lang, source, text): verdicts by sorting the bucketed values of each group."""
    values, groups = {}, defaultdict(list)
    for k, (lang, source, text) in enumerate(rows):
        (n, chars, symbols, dup, rep), failed, lines = plain_counts(text)
        if not failed:
            values[k] = {
                "word_length": 1000 * chars // n, "symbols": 10_000 * symbols // n,
                "repeated_lines": 10_000 * dup // max(lines, 1), "repeated_words": 10_000 * rep // n,
            }
            for key in ((lang or "", source or ""), (lang or "",), ()):
                groups[key].append(values[k])
    out = []
    for k, (lang, source, _) in enumerate(rows):
        keys = [(lang or "", source or ""), (lang or "",), ()]
        fine = k in values
        for m in quality.MEASURES if fine else ():
            key = next((g for g in keys if len(groups[g]) >= quality.LEAST_DOCS), ())
            seen = sorted(plain_bucket(v[m.name]) for v in groups[key])
            low, high = (seen[math.ceil(q * len(seen) / 4) - 1] for q in (1, 3))
            spread = 3 * max(high - low, m.least_spread)
            v = values[k][m.name]
            fine &= v <= high + spread and (not m.below or v >= low - spread)
        out.append(fine)
    return out


def test_verdicts_equal_sorted_groups_of_every_size(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        lang, source = [("en", "a"), ("en", "a"), ("en", "b"), ("de", None), (None, "c")][rng.integers(5)]
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8 if lang == "en" else 12))) for _ in range(rng.integers(40, 90))]
        if k % 11 == 0:
            words = [w + "###" for w in words]
        if k % 13 == 0:
            words = words[:30] * 2
        if k % 17 == 0:
            words = ["\n" + "same line" if i % 4 == 0 else w for i, w in enumerate(words)]
        rows.append((lang, source, " ".join(words)))
    rows += rows[:40] + [("fr", "lone", "a b " + "c d e f g h " * 9), ("fr", "lone", None)]
    docs = texts(spark, [(i, t, lang, source) for i, (lang, source, t) in enumerate(rows)])
    got = {r.doc_id: r.kept for r in quality.rated(docs).collect()}
    want = plain_kept(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert 0 < sum(want) < len(want)
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in enumerate(want) if w}


def test_merged_sketches_equal_the_sketch_of_all(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counted = quality.counts(docs)
    parts = [quality.sketches(counted.filter(f"doc_id % 3 = {k}")) for k in range(3)]
    merged = quality.merged(parts[0].union(parts[1]).union(parts[2]), "lang", "source")
    rows = lambda df: Counter(tuple(r) for r in df.select("lang", "source", "measure", "bucket", "n").collect())
    assert rows(merged) == rows(quality.sketches(counted))


def test_quality_of_no_rows(spark):
    assert quality.rated(texts(spark, [])).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(*r, [1], "x") for r in rows], "vec_id long, embedding array<float>, label int, v array<int>, code string")


def plain_codes(rows):
    """``rows`` of (vec_id, whole components, label) in order of vec_id and components."""
    width = len(rows[0][1])
    cuts = [width * p // 4 for p in range(5)]
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for a, b in zip(cuts, cuts[1:]):
        x = [r[1][a:b] for r in rows]
        entries = [list(v) for v in x[:256]]
        for turn in range(5):
            found = [min((sum((p - q) ** 2 for p, q in zip(v, e)), k) for k, e in enumerate(entries)) for v in x]
            if turn == 4:
                break
            for k in range(len(entries)):
                mine = [v for v, (_, j) in zip(x, found) if j == k]
                if mine:
                    entries[k] = [sum(c) // len(mine) for c in zip(*mine)]
        books += [c for e in entries for c in e]
        codes = [c + f"{k:02x}" for c, (_, k) in zip(codes, found)]
        errors = [e + d for e, (d, _) in zip(errors, found)]
    per_label = defaultdict(int)
    for r, e in zip(rows, errors):
        per_label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return Counter((r[0], c, e, per_label[r[2]], digest) for r, c, e in zip(rows, codes, errors))


def whole(v):
    return [math.floor(float(np.float32(x)) * 1024) for x in v]


def codes_of(frame):
    return Counter(tuple(r) for r in codebooks.encode(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("scale", [1, 0.004, 3e5, 0])
def test_codes_equal_plain_rounds(spark, scale):
    """Small whole numbers give many ties, large ones need more digits than doubles have, 0 makes all rows equal."""
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(420, 8)).astype(np.float32) * np.float32(scale)
    rows = [(int(i), v.tolist(), None if i % 3 == 0 else int(i % 3)) for i, v in enumerate(raw)]
    rows += [(420 + i, rows[i][1], 1) for i in range(30)]  # repeated vectors
    bad = [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] * 8, None)]
    assert codes_of(vectors(spark, bad + rows)) == plain_codes([(i, whole(v), label) for i, v, label in rows])


def test_codes_of_lengths_repeated_ids_and_few_rows(spark):
    short = [(1, [0.5, 1.5, -2.5], 7), (1, [0.25, 1.0, 3.0], 7), (2, [9.0, 9.0, 9.0], None)]
    other = [(3, [1.0, 2.0, 3.0, 4.0, 5.0], None)]
    sort = lambda rows: sorted([(i, whole(v), label) for i, v, label in rows], key=lambda r: r[:2])
    got = {k[:3]: k[3:] for k in codes_of(vectors(spark, short + other + [(5, [], None)]))}
    want = {k[:3]: k[4] for rows in (short, other) for k in plain_codes(sort(rows))}
    assert {k: v[1] for k, v in got.items() if k[0] != 5} == want
    assert (5, "00000000", 0) in got
    assert codes_of(vectors(spark, [])) == Counter()


def test_balls_skip_most_comparisons_and_change_nothing():
    rng = np.random.default_rng(8)
    centres = rng.integers(-400, 400, (64, 6))
    x = centres[rng.integers(64, size=4000)] + rng.integers(-25, 26, (4000, 6))
    before = x[:64].copy()
    code, far = codebooks.full_search(x, before)
    after = np.array([x[code == j].sum(0) // max((code == j).sum(), 1) if (code == j).any() else before[j] for j in range(64)])
    radius = [int(far[code == j].max()) if (code == j).any() else None for j in range(64)]
    balls = codebooks.Balls(after, before, radius)
    best, away, compared = balls.search(x, code, far)
    want, want_far = codebooks.full_search(x, after)
    assert (best == want).all() and (away == want_far).all()
    assert compared < 0.3 * len(x) * 64
    still = codebooks.Balls(after, after, [int(want_far[want == j].max()) if (want == j).any() else None for j in range(64)])
    assert all(still.stable) and still.search(x, want, want_far)[2] == 0


def plain_audit(rows, least_docs, listed):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = Counter()
    for lang, found in docs.items():
        terms = sorted(t for t, n in found.items() if n >= least_docs)
        sources = [s for a, s in counts if a == lang]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(terms))
        total = {s: sum(counts[lang, s][t] for t in terms) for s in sources}
        p = {s: [share(counts[lang, s][t], total[s]) for t in terms] for s in sources}
        q = [share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in terms]
        for s in sources:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s)
            more = sorted((b - a, t.encode(), t) for a, b, t in zip(p[s], q, terms) if counts[lang, s][t] and a > b)[:listed]
            for part, ranked in (("pair", pairs), ("term", more)):
                out.update((lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(ranked, 1))
    return out


def test_divergence_equals_plain_loops(spark):
    rng = np.random.default_rng(11)
    terms = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "é", "Ünder", "日本"]
    rows = []
    for k in range(260):
        lang, source = ("en", f"s{rng.integers(90)}") if k % 2 else (None if k % 4 else "de", [None, "x", "é", "Z"][rng.integers(4)])
        words = rng.choice(terms, rng.integers(0, 120), p=np.arange(304, 0, -1) / np.arange(305).sum())
        rows.append((k, " ".join(words).replace("wa", "WA") + " 12-3_x", lang, source))
    rows += [(300, None, "lone", "s"), (301, "", "void", "a"), (302, "12 3", "void", "b"), (303, None, None, None), rows[0]]
    docs = texts(spark, rows)
    got = Counter(tuple(r) for r in divergence.audit(docs, 6, 7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 6, 7)
    assert any(k[0] == "void" and k[4] == 0 for k in got) and not any(k[0] == "lone" for k in got)


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 3 * 10**17 + 1, 9 * 10**18, 10**6
    got = spark.range(1).select(divergence.share(f"{n}L", f"{total}L", f"{v}L").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_divergence_of_no_rows(spark):
    assert divergence.audit(texts(spark, [])).collect() == []
