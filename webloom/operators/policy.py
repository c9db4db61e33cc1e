"""Small decisions of the crawler and the page store, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT_FAILURE = 300
HEARTBEAT_STALE = 45
LEASE = 60
MAX_USED = 0.95
MIN_SIDE, MAX_PIXELS = 100, 40_000_000
SEARCH_GAP = 2.0
# fixed values: titles of pages that ask a browser for patience
CHALLENGE_TITLES = ("Just a moment...",)


def recently_failed(failed_time: Column, now: Column) -> Column:
    return F.coalesce(failed_time > now - RECENT_FAILURE, F.lit(False))


def crawl_allowed(interactive_only: Column, windowed: Column, open_until: Column, now: Column) -> Column:
    """Whether ordinary crawling may run: never in interactive mode, else always or inside the open window."""
    return ~F.coalesce(interactive_only == "1", F.lit(False)) & (~windowed | (F.coalesce(F.try_to_number(open_until, F.lit("999999999999")).cast("long"), F.lit(0)) > now))


def lease_until(closes_at: Column, now: Column) -> Column:
    """The end of a window's lease, which has to be renewed before it runs out."""
    return F.least(closes_at, now + LEASE)


def below_host(host: Column, suffixes: Column) -> Column:
    """Whether a host is one of ``suffixes`` (array) or stands below one, at a dot."""
    name = F.lower(F.btrim(host, F.lit(".")))
    return F.exists(suffixes, lambda s: (name == s) | F.endswith(name, F.concat(F.lit("."), s)))


def write_allowed(free: Column, total: Column, least: int) -> Column:
    """Disk reserve: enough bytes free and less than MAX_USED of the disk used; impossible readings are refused."""
    sound = (free >= 0) & (total > 0) & (free <= total)
    return F.coalesce(sound & (free >= least) & (1 - free / total < MAX_USED), F.lit(False))


def usable_image(width: Column, height: Column) -> Column:
    return F.coalesce((width >= MIN_SIDE) & (height >= MIN_SIDE) & (width.cast("long") * height <= MAX_PIXELS), F.lit(False))


def crawler_running(heartbeat: Column, now: Column) -> Column:
    return F.coalesce(now - heartbeat <= HEARTBEAT_STALE, F.lit(False))


def is_challenge(title: Column) -> Column:
    return F.coalesce(title.isin(*CHALLENGE_TITLES), F.lit(False))


def earliest_request(requests: DataFrame) -> DataFrame:
    """The active request whose deadline comes first (one row, the smallest id of equals)."""
    best = F.min_by(F.struct("request_id", "item_id", "deadline"), F.struct("deadline", "request_id"))
    return requests.where(F.col("failure").isNull()).agg(best.alias("r")).where("r is not null").select("r.*")


def egress(requests: DataFrame, addresses: int) -> DataFrame:
    """Round-robin addresses of requests in order (id): number ``n`` goes to n mod ``addresses``.

    Ranges of ids are counted first, so no task ranks more than one of them.
    """
    parts = requests.repartitionByRange("id").select("id", F.spark_partition_id().alias("__p"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # one row per range
    ranked = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("id")) - 1)
    return ranked.join(start, "__p").select("id", F.pmod(F.col("__r") + F.col("__start"), F.lit(addresses)).cast("int").alias("address"))


def throttle_gaps(searches: DataFrame, least: float = SEARCH_GAP) -> DataFrame:
    """Searches (engine, id, start, end) that began sooner than ``least`` (in the unit of the times) after the one before them had ended."""
    before = F.lag("end").over(Window.partitionBy("engine").orderBy("start", "id"))
    return searches.withColumn("gap", F.col("start") - before).where(F.col("gap") < least).select("engine", "id", "gap")


def neighbours(links: DataFrame, item: int, outgoing: bool, after: int | None = None, size: int = 200) -> DataFrame:
    """One page of an item's children or parents, by id, after the last one seen."""
    own, other = ("parent_id", "child_id") if outgoing else ("child_id", "parent_id")
    later = F.lit(True) if after is None else F.col(other) > after
    return links.where((F.col(own) == item) & later).select(own, other).orderBy(other).limit(size)


def reextraction(items: DataFrame) -> DataFrame:
    """status of each item (stored html read anew as ``new_text``): unreadable, unchanged or changed."""
    return items.withColumn("status", F.when(F.coalesce("html", F.lit("")) == "", "unreadable").when(F.col("new_text").eqNullSafe(F.col("full_text")), "unchanged").otherwise("changed"))


class PoolCache:
    """Ranked pools by query and limit, for one version of the link index; a new version forgets all.

    A pool is kept while it is small (``most`` rows), as rows and not as a plan.
    """

    def __init__(self, most: int = 10_000):
        self.most, self.version, self.pools = most, None, {}

    def get(self, version: int, query: str, limit: int, compute) -> DataFrame:
        if version != self.version:
            for pool in self.pools.values():
                pool.unpersist()
            self.version, self.pools = version, {}
        if (query, limit) not in self.pools:
            pool = compute()
            if limit > self.most:
                return pool
            self.pools[(query, limit)] = pool.persist()
        return self.pools[(query, limit)]
