"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.session import materialise, scratch_path

__all__ = ["RecentMap", "crc_bucket", "keyed_texts", "materialise", "mix", "scratch_path", "slices", "table"]

#: Characters of text that a task turns into Python objects at a time.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty one; other columns never reach the tasks."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32 of the value as text, modulo ``buckets``; null where the value is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(buckets)


def slices(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``SLICE_CHARS`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        marks = np.cumsum(sizes) // SLICE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


class RecentMap(dict):
    """Memo of bounded size: what was not used among the last ``limit`` new or renewed keys may go.

    ``find(keys)`` asks ``make(list of unknown keys)`` for the values of unknown keys.
    """

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def find(self, keys: Sequence) -> list:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        values = list(map(self.get, keys))
        places = [i for i, v in enumerate(values) if v is None]
        if not places:
            return values
        unknown = {keys[i] for i in places}
        old = self.old.get
        self.update((k, v) for k in unknown if (v := old(k)) is not None)
        make = [k for k in unknown if k not in self]
        if make:
            self.update(zip(make, self.make(make)))
        for i in places:
            values[i] = self[keys[i]]
        return values


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash from two (order matters); wraps modulo 2**64."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b) if np.isscalar(b) else (
            (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
        )
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))
