"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(labelled: DataFrame, limit: int, salt: int) -> DataFrame:
    """At most ``limit`` of the narrow rows (doc_id, label, ...), by lowest hash of doc_id.

    The count decides a hash threshold first, so hardly more than ``limit`` rows reach the final sort.
    """
    order = F.xxhash64("doc_id", F.lit(salt))
    total = labelled.count()
    if total > limit:
        share = min(1.0, 1.3 * limit / total)
        labelled = labelled.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        return labelled.orderBy(F.pmod(order, F.lit(1 << 20)), "doc_id").limit(limit)
    return labelled
