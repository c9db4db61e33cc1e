"""Bounded, deterministic samples for fitting classifiers, and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Classes whose counts are broadcast (some tens of bytes each); more are joined by shuffle.
BROADCAST_CLASSES = 10_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def per_class(rows: DataFrame, label: str, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows of each class at most, chosen by a hash of ``key``.

    The counts of the classes are one row per class; a class above the limit is thinned by
    the same share everywhere. While there are at most BROADCAST_CLASSES classes, rows stay where
    they are and only those chosen travel on; no class meets in one task. Rows with a null label go.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if counts.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        counts = F.broadcast(counts)
    share = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(counts, label).where(share * F.col("__n") < F.lit(float(limit))).drop("__n")
