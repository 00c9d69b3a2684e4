"""Toxicity scores by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Every coordinate has its own learning rate and L1 keeps most weights at exactly zero, so the model is a
short list of (slot, weight). The features of a bounded labelled sample are hashed in parallel and then
learned in one stream, as the method asks; scoring looks weights up in every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import crc_bucket, keyed_texts, mix, slices
from beaconry.llm.sampling import labelled_sample
from beaconry.llm.words import hashed_words

SLOT_BITS = 20
#: Documented bound: so many labelled rows at most are used for fitting.
SAMPLE_ROWS = 24_000
EPOCHS = 5
#: Slots that fewer rows of the sample have are not learned.
LEAST_ROWS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
#: Slot of the constant feature.
BIAS = 0


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, adjacent pair and pair with one word between; repeats included."""
    row, h = hashed_words(texts)
    near, far = row[1:] == row[:-1], row[2:] == row[:-2]
    pairs = mix(h[:-1], h[1:])[near]
    skips = mix(h[:-2], h[2:] ^ np.uint64(0x5851F42D4C957F2D))[far]
    slots = np.concatenate([mix(h, 7), pairs, skips]) >> np.uint64(64 - SLOT_BITS)
    slots[slots == BIAS] = 1
    return np.concatenate([row, row[:-1][near], row[:-2][far]]), slots.astype(np.int64)


def _distinct(texts: list[str]) -> list[np.ndarray]:
    """Per text its distinct slots and the constant feature."""
    row, slot = features(texts)
    both = np.unique(row << SLOT_BITS | slot)
    parts = np.searchsorted(both >> SLOT_BITS, np.arange(1, len(texts)))
    return [np.append(p & ((1 << SLOT_BITS) - 1), BIAS) for p in np.split(both, parts)]


class Ftrl:
    """FTRL-proximal state: z, and n (the sum of squared gradients) per coordinate."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z = self.z[slots]
        l1 = np.where(slots == BIAS, 0.0, L1)
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((BETA + np.sqrt(self.n[slots])) / ALPHA + L2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


@dataclass
class Model:
    """Non-zero weights only; at most one per slot, so the size is bounded whatever the corpus."""

    slots: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << SLOT_BITS)
        out[self.slots] = self.weights
        return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows of ``labels`` (doc_id, toxic) with crc32(doc_id as text) mod 5 other than 0.

    Of several labels of one doc_id the largest counts; null labels and ids are left out. Without any
    labelled row the model is empty and every score is 0.5.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    usable = usable.filter((crc_bucket("doc_id", 5) != 0) & F.col("label").isNotNull())
    usable = labelled_sample(usable.groupBy("doc_id").agg(F.max("label").alias("label")), sample_rows, 6)
    # At most sample_rows pairs of numbers: small enough to send to every task.
    rows = keyed_texts(docs).join(F.broadcast(usable), "doc_id").select("doc_id", "text", "label")

    def hashed(batches):
        for batch in slices(batches):
            slots = pa.array(_distinct(batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), slots], ["doc_id", "label", "slots"])

    def learn(batches):
        seen, rows_with = [], np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            flat, cuts = batch.column(2).flatten().to_numpy(), np.asarray(batch.column(2).offsets)
            cuts = cuts - cuts[0]
            for i, label in enumerate(labels):
                slots = flat[cuts[i] : cuts[i + 1]]
                rows_with[slots] += 1
                seen.append((slots, label > 0))
        rows_with[BIAS] = max(rows_with[BIAS], LEAST_ROWS)
        seen = [(slots[rows_with[slots] >= LEAST_ROWS], label) for slots, label in seen]
        model = Ftrl()
        for _ in range(EPOCHS):
            for slots, label in seen:
                model.learn(slots, label)
        weights = model.weights(np.arange(1 << SLOT_BITS))
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], ["slot", "weight"])

    found = (
        rows.mapInArrow(hashed, "doc_id long, label int, slots array<int>")
        .repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(66)), "doc_id", "slots")
        .mapInArrow(learn, "slot long, weight double").toPandas()
    )
    return Model(found["slot"].to_numpy(np.int64), found["weight"].to_numpy(float))


_DENSE: dict[int, np.ndarray] = {}


class _Sent:
    """A broadcast model under a name that tasks of one worker recognise."""

    def __init__(self, docs: DataFrame, model: Model):
        self.broadcast = docs.sparkSession.sparkContext.broadcast(model)
        self.name = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "name": self.name}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.name not in _DENSE:
            _DENSE.clear()
            _DENSE[self.name] = self.broadcast.value.dense()
        w = _DENSE[self.name]
        row, slot = features(texts)
        hit = np.flatnonzero(w[slot])
        both = np.unique(row[hit] << SLOT_BITS | slot[hit])
        sums = np.full(len(texts), w[BIAS])
        np.add.at(sums, both >> SLOT_BITS, w[both & ((1 << SLOT_BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from the text alone.

    A null or empty text gets the score of the constant feature; a repeated feature counts once, so
    length does not matter by itself. Extra columns are not looked at; an empty table gives no row.
    """
    sent = _Sent(docs, model)

    def apply(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return keyed_texts(docs).mapInArrow(apply, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of 0.5 on)."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below ``least``."""
    sent = _Sent(docs, model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([texts], ["text"])], text=0)
        return pa.array(np.concatenate([np.zeros(0), *(sent.scores(p.column(0).to_pylist()) for p in parts)]))

    return docs.filter(scores(F.coalesce(F.col("text").cast("string"), F.lit(""))) < least)
