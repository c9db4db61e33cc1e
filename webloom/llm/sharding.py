"""Sharding by rendezvous hashing of a stable key over weighted shards.

For each shard the key and the shard's number are hashed together; the highest weighted draw
wins (``-w / ln(u)``; with equal weights simply the largest hash). The number of shards enters
only by which draws exist, so one more shard takes rows from the others and moves none between
them. Within a shard, rows get gapless slots: rows fall into sub-buckets by a hash of the key and
the text's crc32, sub-buckets get offsets from their counts, and only the rows of one sub-bucket
are ranked together. The number of sub-buckets grows with the table, so each has about
``BUCKET_ROWS`` rows, also of a null key that many rows share; repeated rows (one key, one text)
alone stay together.

Cases: null keys hash as an empty text and share one shard; null text has 0 bytes; rows with
the same key share a shard and get different slots; an
empty table gives an empty result; shards of weight 0 or less get nothing. Native throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed bytes that a record takes beside its text.
OVERHEAD = 16
SHARDS = 40
#: Rows of a sub-bucket if all rows were in one shard, and the least number of sub-buckets.
BUCKET_ROWS, SUB_BUCKETS = 20_000, 64


def draw(key: Column, shard: Column) -> Column:
    """A 60-bit hash of key and shard, as a fixed-length hex text (compares like the number)."""
    return F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 15)


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard of ``key`` among 0 .. shards - 1."""
    weights = list(weights) if weights is not None else [1.0] * shards
    if len(weights) != shards or not any(w > 0 for w in weights):
        raise ValueError("one weight for each shard is needed, and one above 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    numbers = F.array(*(F.lit(i) for i in range(shards) if weights[i] > 0))
    if len({w for w in weights if w > 0}) == 1:
        drawn = F.transform(numbers, lambda s: F.struct(draw(key, s).alias("h"), s.alias("s")))
    else:
        table = F.array(*(F.lit(float(w)) for w in weights))
        unit = lambda s: (F.conv(draw(key, s), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 60))
        drawn = F.transform(numbers, lambda s: F.struct((-F.element_at(table, s + 1) / F.log(unit(s))).alias("h"), s.alias("s")))
    return F.array_max(drawn).getField("s")


def with_slots(rows: DataFrame, shard: str, key: str, ties: Sequence[str], number: int) -> DataFrame:
    """Add a gapless ``slot`` from 0 within each shard without ranking a whole shard at once; ``number``: about how many rows there are."""
    sub_buckets = max(SUB_BUCKETS, -(-number // BUCKET_ROWS))
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), *ties, F.lit(17)), F.lit(sub_buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(shard, "__sub").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(F.col(shard).alias("__shard"), F.col("__sub").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(shard, "__sub").orderBy(F.col(key).asc_nulls_first(), *ties)
    ranked = rows.withColumn("__rank", F.row_number().over(within) - 1)
    joined = ranked.join(offsets, (F.col(shard) == F.col("__shard")) & (F.col("__sub") == F.col("__of")))
    return joined.withColumn("slot", F.col("__offset") + F.col("__rank")).drop("__sub", "__shard", "__of", "__offset", "__rank")


def assign(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    more = None if weights is None else [*weights, sum(weights) / len(weights)]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), shards, weights).alias("shard"),
    )
    if more is None:
        # one further draw; it wins exactly where it beats the winner's (ties go to the larger number)
        name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        grown = F.when(draw(name, F.lit(shards)) >= draw(name, F.col("shard")), F.lit(shards)).otherwise(F.col("shard"))
    else:
        grown = rendezvous(F.col("doc_id"), shards + 1, more)
    return with_slots(rows, "shard", "doc_id", ["text_crc32", "size"], docs.count()).withColumn("grown_shard", grown)
