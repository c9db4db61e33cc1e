"""Predicates and scalar rules of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: indexable content types
PAGE_TYPES = ("text/html", "application/xhtml+xml", "application/pdf", "text/plain")
MIN_DELAY, RATE_LIMITED_DELAY, MAX_DELAY = 60, 300, 3600
BACKOFF_START, BACKOFF_MOST = 300, 604800
RECRAWL_START, RECRAWL_MOST = 604800, 4838400
DEAD_TTL = 90 * 86400


def is_image(kind: Column) -> Column:
    return kind.ilike("image/%")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def searchable() -> Column:
    """Crawled, not noindex, an indexable type, and some text."""
    kind = F.lower("type")
    return F.col("crawled_time").isNotNull() & (F.col("noindex") == 0) & (kind.isin(*PAGE_TYPES) | is_image(kind)) & (_filled(F.col("title")) | _filled(F.col("description")) | _filled(F.col("full_text")))


def presentable() -> Column:
    return F.col("crawled_time").isNotNull() & (F.col("noindex") == 0)


def host_ready(now: int) -> Column:
    return (F.col("priority") > 0) | F.col("next_crawl").isNull() | (F.col("next_crawl") <= now)


def claim_free(now: int) -> Column:
    return F.col("claimed_until").isNull() | (F.col("claimed_until") <= now)


def honoured_delay(delay: Column) -> Column:
    return F.greatest(F.lit(MIN_DELAY), F.least(F.coalesce(delay, F.lit(MIN_DELAY)), F.lit(MAX_DELAY)))


def next_crawl_after(now: Column, status: Column, delay: Column) -> Column:
    return now + F.greatest(F.when(status.isin(429, 503), RATE_LIMITED_DELAY).otherwise(MIN_DELAY), honoured_delay(delay))


def failure_backoff(failures: Column) -> Column:
    return F.least(F.lit(BACKOFF_START) * F.pow(F.lit(2), F.least(failures - 1, F.lit(20))), F.lit(BACKOFF_MOST)).cast("long")


def next_interval(unchanged: Column, previous: Column) -> Column:
    return F.when(unchanged, F.least(previous * 2, F.lit(RECRAWL_MOST))).otherwise(F.lit(RECRAWL_START))


def window_start(t: Column, seconds: int = 60) -> Column:
    return (F.floor(t / seconds) * seconds).cast("long")


def retry_after(t: Column, seconds: int = 60) -> Column:
    return F.greatest(F.lit(1), window_start(t, seconds) + seconds - t)


def packed_edge(parent: Column, child: Column) -> Column:
    """parent * 2**32 + child; parents beyond 31 bits are an error."""
    return F.when(parent > 2147483647, F.raise_error(F.lit("parent id beyond 31 bits")).cast("long")).otherwise(F.shiftleft(parent, 32) + child)


def thumbnail_shard(item_id: Column) -> Column:
    part = lambda n: F.format_string("%02d", F.pmod(F.floor(item_id / n).cast("long"), F.lit(100)))
    return F.concat_ws("/", part(1), part(100), part(10000))


def retrieval_state(now: Column) -> Column:
    """failed, available, reading or queued, by deadline, failure, crawl and claim."""
    return F.when(F.col("failure").isNotNull(), "failed").when(F.col("crawled_time").isNotNull(), "available").when(F.col("deadline") <= now, "failed").when(F.col("claimed_until") > now, "reading").otherwise("queued")
