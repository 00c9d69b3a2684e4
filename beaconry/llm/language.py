"""Language of a text by unigram models over the pieces of a fixed public vocabulary.

Each language has a probability for every piece. A word's probability is the sum over all ways to cut it
into pieces, by the forward algorithm; a text's is the product over its words. The probabilities are fitted
by expectation maximisation (forward and backward sums) on word counts of a bounded labelled sample. Texts without
blanks are long words: their sums run over the whole stretch, in logarithms.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import RecentMap, crc_bucket, keyed_texts, materialise, slices
from beaconry.llm.sampling import labelled_sample

#: Documented bound: so many labelled rows at most are used for fitting.
SAMPLE_ROWS = 6_000
ROUNDS = 2
#: Longer pieces are not used. Scores of longer words are not remembered, and the fit takes such words in parts.
LONGEST_PIECE, LONGEST_WORD = 10, 40
#: Bytes of long words that are scored side by side, about.
LONG_BYTES = 100_000
#: Expected count that every piece has besides what the sample shows.
PRIOR_COUNT = 0.01
#: Scale per byte that keeps products of probabilities within range.
PER_BYTE = 64.0
UNKNOWN = "und"

_BREAKS = bytes(b if b >= 128 or chr(b) in "abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_of(text: str) -> list[bytes]:
    """Lower-cased stretches of ASCII letters and non-ASCII characters."""
    return text.lower().encode().translate(_BREAKS).split()


def parts_of(word: bytes) -> list[bytes]:
    """A word in parts of ``LONGEST_WORD`` bytes at most, cut between characters."""
    parts = []
    while len(word) > LONGEST_WORD:
        cut = LONGEST_WORD
        while word[cut] & 0xC0 == 0x80:
            cut -= 1
        parts.append(word[:cut])
        word = word[cut:]
    return [*parts, word]


class Pieces:
    """Piece numbers of all short stretches of many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            own = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        self.pieces = [p for p in own if len(p) <= LONGEST_PIECE and p == p.lower()]
        self.count = len(self.pieces)
        by_length = defaultdict(list)
        for i, p in enumerate(self.pieces):
            by_length[len(p)].append(i)
        keys = np.zeros(self.count, np.uint64)
        for length, which in by_length.items():
            text = np.frombuffer(b"".join(self.pieces[i] for i in which), np.uint8).reshape(-1, length)
            for j in range(length):
                keys[which] = self.step(keys[which], text[:, j])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[keys >> np.uint64(42)] = True

    @staticmethod
    def step(keys: np.ndarray, byte: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys ^ (byte.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)

    def lattice(self, words: np.ndarray) -> np.ndarray:
        """words: rows of equally many bytes. Number of the piece at [row, begin, length - 1]; ``count`` if none."""
        rows, width = words.shape
        most = min(LONGEST_PIECE, width)
        out = np.full((rows, width, most), self.count, np.int32)
        keys = np.zeros((rows, width), np.uint64)
        for k in range(most):
            keys = self.step(keys[:, : width - k], words[:, k:])
            r, i = np.nonzero(self.maybe[keys >> np.uint64(42)])
            found = keys[r, i]
            at = np.minimum(np.searchsorted(self.keys, found), self.count - 1)
            right = self.keys[at] == found
            out[r[right], i[right], k] = self.order[at[right]]
        return out


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One per worker process and file."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def forward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums over all cuts of each prefix: [row, bytes so far, language], scaled by ``PER_BYTE`` per byte.

    table: [piece, language], the last piece (none) with zeros.
    """
    rows, width, most = ids.shape
    a = np.zeros((rows, width + 1, table.shape[1]))
    a[:, 0] = 1
    for end in range(1, width + 1):
        for k in range(1, min(most, end) + 1):
            a[:, end] += a[:, end - k] * table[ids[:, end - k, k - 1]]
    return a


def forward_long(ids: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all cuts of the first ``lengths`` bytes of each row: [row, language].

    Only the last columns are carried on, and brought back to a common size from time to time.
    """
    rows, width, most = ids.shape
    columns = [np.ones((rows, table.shape[1]))]
    size, out = np.zeros((rows, table.shape[1])), np.zeros((rows, table.shape[1]))
    for end in range(1, width + 1):
        new = sum(columns[-k] * table[ids[:, end - k, k - 1]] for k in range(1, min(most, end) + 1))
        columns = [*columns[-most + 1 :], new] if most > 1 else [new]
        done = lengths == end
        if done.any():
            out[done] = np.log(np.maximum(new[done], 1e-300)) + size[done]
        if end % 16 == 0:
            top = np.maximum(np.max(columns, 0), 1e-300)
            columns = [c / top for c in columns]
            size += np.log(top)
    return out


def backward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    rows, width, most = ids.shape
    b = np.zeros((rows, width + 1, table.shape[1]))
    b[:, width] = 1
    for begin in range(width - 1, -1, -1):
        for k in range(1, min(most, width - begin) + 1):
            b[:, begin] += b[:, begin + k] * table[ids[:, begin, k - 1]]
    return b


def scaled(table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Probabilities [language, piece] as the factors that ``forward`` takes."""
    lengths = np.array([len(p) for p in pieces.pieces])
    return np.concatenate([(table * PER_BYTE**lengths).T, np.zeros((1, len(table)))])


def by_length(words: list[bytes], most: int = 4_096):
    """(numbers, byte matrix) of words of one length after the other; every word gets a blank in front."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for length, which in sorted(groups.items()):
        for at in range(0, len(which), most):
            part = which[at : at + most]
            text = np.frombuffer(b" " + b" ".join([words[i] for i in part]), np.uint8).reshape(-1, length + 1)
            yield np.array(part), text


class Scorer:
    def __init__(self, path: str, table: np.ndarray):
        self.pieces = pieces_of(path)
        self.table = scaled(table, self.pieces)
        self.languages = len(table)
        self.known = RecentMap(self._score, 60_000)

    def _score(self, words: list[bytes]) -> list[bytes]:
        out = np.zeros((len(words), self.languages), np.float32)
        for which, text in by_length(words):
            total = forward(self.pieces.lattice(text), self.table)[:, -1]
            out[which] = np.log(np.maximum(total, 1e-300)) - text.shape[1] * np.log(PER_BYTE)
        data, width = out.tobytes(), 4 * self.languages
        return [data[i : i + width] for i in range(0, len(data), width)]

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text in each language."""
        words = [words_of(t) for t in texts]
        long = [(i, w) for i, ws in enumerate(words) for w in ws if len(w) > LONGEST_WORD]
        if long:
            words = [[w for w in ws if len(w) <= LONGEST_WORD] for ws in words]
        flat = np.frombuffer(b"".join(self.known.find([w for ws in words for w in ws])), np.float32).reshape(-1, self.languages)
        ends = np.cumsum([len(w) for w in words])
        sums = np.concatenate([np.zeros((1, self.languages)), np.cumsum(flat, 0, dtype=np.float64)])
        out = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        if long:
            np.add.at(out, [i for i, _ in long], self._score_long([w for _, w in long]))
        return out

    def _score_long(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.languages))
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        while len(order):
            # Words of like length side by side; bytes behind a word's end do not touch its sum.
            some = order[: int(np.searchsorted(lengths[order] * np.arange(1, len(order) + 1), LONG_BYTES)) or 1]
            width = int(lengths[some[-1]])
            text = np.frombuffer(b"".join((b" " + words[i]).ljust(width, b" ") for i in some), np.uint8).reshape(-1, width)
            out[some] = forward_long(self.pieces.lattice(text), self.table, lengths[some]) - (lengths[some] * np.log(PER_BYTE))[:, None]
            order = order[len(some) :]
        return out


class Model:
    """Languages, log share of each in the sample, and piece probabilities [language, piece]."""

    def __init__(self, languages: list[str], shares: np.ndarray, table: np.ndarray):
        self.languages, self.shares, self.table = languages, shares, table


def fit(docs: DataFrame, vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on documents with a language whose crc32(doc_id as text) mod 4 is other than 2.

    The model holds one row of piece probabilities per language of the sample.
    """
    vocabulary = vocabulary or default_path()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    usable = named.filter((crc_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull())
    usable = labelled_sample(usable.groupBy("doc_id").agg(F.min("lang").alias("lang")), sample_rows, 7)
    # At most sample_rows short rows: small enough to send to every task.
    rows = keyed_texts(docs).join(F.broadcast(usable), "doc_id").select("doc_id", "text", "lang")

    def count(batches):
        for batch in slices(batches):
            counts: dict = defaultdict(Counter)
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts[lang].update(p for w in words_of(text) for p in parts_of(w))
            flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat)], ["lang", "word", "n"])

    counted = rows.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "words")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(shares)
    pieces = pieces_of(vocabulary)
    table = np.full((len(languages), pieces.count), 1 / pieces.count)
    for _ in range(rounds if languages else 0):
        sent = docs.sparkSession.sparkContext.broadcast((vocabulary, languages, table))
        expected = counted.mapInArrow(_expect(sent), "lang int, piece int, n double")
        found = expected.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        table = np.full(table.shape, PRIOR_COUNT)
        np.add.at(table, (found["lang"].to_numpy(), found["piece"].to_numpy()), found["n"].to_numpy())
        table /= table.sum(1, keepdims=True)
    total = max(1, sum(shares.values()))
    return Model(languages, np.log(np.array([shares[x] for x in languages]) / total), table)


def _expect(sent):
    def expect(batches):
        path, languages, table = sent.value
        pieces = pieces_of(path)
        number = {lang: i for i, lang in enumerate(languages)}
        factors = scaled(table, pieces)
        sums = np.zeros((len(languages), pieces.count + 1))
        for batch in batches:
            langs, words, counts = (c.to_pylist() for c in batch.columns)
            for lang in set(langs):
                of = [i for i, x in enumerate(langs) if x == lang]
                own, n = factors[:, [number[lang]]], np.array([counts[i] for i in of], float)
                for which, text in by_length([words[i] for i in of]):
                    ids = pieces.lattice(text)
                    a, b = forward(ids, own)[:, :, 0], backward(ids, own)[:, :, 0]
                    weight = n[which] / a[:, -1]
                    for k in range(1, ids.shape[2] + 1):
                        at = ids[:, : ids.shape[1] - k + 1, k - 1]
                        share = a[:, : -k] * own[at, 0] * b[:, k:] * weight[:, None]
                        np.add.at(sums[number[lang]], at.ravel(), share.ravel())
        lang, piece = np.nonzero(sums[:, :-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[lang, piece])], ["lang", "piece", "n"]
        )

    return expect


_SCORERS: dict[int, Scorer] = {}


def identify(docs: DataFrame, model: Model, vocabulary: str | None = None) -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the summed probabilities) of every row.

    A null text or one without letters is ``und`` with score 0, and so is every row if the model knows
    no language. Repeated rows are judged each for itself, an empty table gives no row, and columns
    besides doc_id and text are not looked at.
    """
    vocabulary = vocabulary or default_path()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = sent._jbroadcast.id()

    def apply(batches):
        known = sent.value
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(vocabulary, known.table)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known.languages:
                logs = _SCORERS[name].score(texts) + known.shares
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                for i, t in enumerate(texts):
                    if _LETTER(t):
                        pred[i], score[i] = known.languages[best[i]], float(share[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return keyed_texts(docs).mapInArrow(apply, "doc_id long, lang_pred string, score double")


def language(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. ``docs`` needs doc_id, text and lang."""
    found = identify(docs, fit(docs, vocabulary), vocabulary)
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
