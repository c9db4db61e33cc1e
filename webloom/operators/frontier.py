"""The crawl frontier: what to fetch next, politeness, backoff and recrawl, as set operations.

A batch of k picks at a fixed time equals k sequential picks: rows of a ready host are ranked
by class (interactive, fresh, recrawl, stalled) and the class's own key; an ordinary row counts
only if it is the first of its host, as a pick reserves the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.predicates import claim_free, failure_backoff, host_ready, next_interval

INTERACTIVE, FOCUSED, FRESH, RECRAWL, STALLED = -2, -1, 0, 1, 2


def due(rows: DataFrame) -> DataFrame:
    return rows.withColumn("due", F.col("crawled_time") + F.col("recrawl_after"))


def fresh(frontier: DataFrame, now: int) -> DataFrame:
    """Uncrawled, never claimed, host ready; by priority, then id."""
    rows = frontier.where(F.col("crawled_time").isNull() & F.col("claimed_until").isNull() & host_ready(now))
    return rows.select("item_id", "host_id", "priority", F.lit(FRESH).alias("class"), (-F.col("priority")).cast("long").alias("k"))


def recrawl(frontier: DataFrame, now: int) -> DataFrame:
    rows = due(frontier).where((F.col("due") <= now) & claim_free(now) & host_ready(now))
    return rows.select("item_id", "host_id", "priority", F.lit(RECRAWL).alias("class"), F.col("due").cast("long").alias("k"))


def stalled(frontier: DataFrame, now: int) -> DataFrame:
    """Uncrawled rows whose claim ran out."""
    rows = frontier.where(F.col("crawled_time").isNull() & (F.col("claimed_until") <= now) & host_ready(now))
    return rows.select("item_id", "host_id", "priority", F.lit(STALLED).alias("class"), F.lit(0).cast("long").alias("k"))


def with_hosts(items: DataFrame, hosts: DataFrame, condition: Column) -> DataFrame:
    """Items that fulfil ``condition`` with their host's columns; the filter runs before the join."""
    return items.where(condition).join(hosts, "host_id")


def pick(candidates: DataFrame, size: int) -> DataFrame:
    return candidates.orderBy("class", "k", "item_id").limit(size)


def interactive(frontier: DataFrame, live: DataFrame, now: int, size: int) -> DataFrame:
    """Items with a live request, by id; they wait for no host."""
    asked = live.select("item_id").distinct()
    return frontier.where((F.col("priority") > 0) & F.col("crawled_time").isNull() & claim_free(now)).join(asked, "item_id", "left_semi").select("item_id", "host_id").orderBy("item_id").limit(size)


def batch(frontier: DataFrame, now: int, size: int) -> DataFrame:
    """The next ``size`` picks. A host's later ordinary rows go before the global sort, by a partial top-1."""
    ready = fresh(frontier, now).unionByName(recrawl(frontier, now)).unionByName(stalled(frontier, now))
    first = Window.partitionBy("host_id").orderBy("class", "k", "item_id")
    ordinary = ready.where("priority = 0").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return ready.where("priority > 0").unionByName(ordinary).orderBy("class", "k", "item_id").limit(size)


def full_batch(frontier: DataFrame, live: DataFrame, focused: DataFrame, now: int, size: int) -> DataFrame:
    """The next ``size`` picks over all classes: interactive items (they wait for no host), focused candidates, then the rest.

    ``focused`` has item_id and score; such an item is picked like a fresh one whose host is ready,
    the best score first. An item stands in its best class only.
    """
    asked = interactive(frontier, live, now, 2**31 - 1).join(frontier.select("item_id", "priority"), "item_id").select("item_id", "host_id", "priority", F.lit(INTERACTIVE).alias("class"), F.col("item_id").cast("long").alias("k"))
    best = fresh(frontier, now).drop("class", "k").join(focused.select("item_id", "score"), "item_id").select("item_id", "host_id", "priority", F.lit(FOCUSED).alias("class"), (-F.col("score")).cast("long").alias("k"))
    ready = asked.unionByName(best).unionByName(fresh(frontier, now)).unionByName(recrawl(frontier, now)).unionByName(stalled(frontier, now))
    ready = ready.groupBy("item_id", "host_id", "priority").agg(F.min(F.struct("class", "k")).alias("o")).select("item_id", "host_id", "priority", "o.class", "o.k")
    first = Window.partitionBy("host_id").orderBy("class", "k", "item_id")
    ordinary = ready.where("priority = 0").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return ready.where("priority > 0").unionByName(ordinary).orderBy("class", "k", "item_id").limit(size)


def backoff(events: DataFrame) -> DataFrame:
    """host_id, t, ok -> consecutive failures and the pause after each event (gaps and islands)."""
    order = Window.partitionBy("host_id").orderBy("t", "event_id")
    run = events.withColumn("island", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("host_id", "island").orderBy("t", "event_id")
    counted = run.withColumn("failures", F.when(F.col("ok"), 0).otherwise(F.sum((~F.col("ok")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    return counted.select("event_id", "host_id", "failures", F.when(F.col("failures") > 0, failure_backoff(F.col("failures"))).otherwise(F.lit(0)).cast("long").alias("pause"))


def recrawl_step(crawls: DataFrame) -> DataFrame:
    """One step of the adaptive interval: the hash before and its interval give the next interval and due time."""
    order = Window.partitionBy("item_id").orderBy("t", "event_id")
    step = crawls.withColumn("unchanged", F.coalesce(F.col("hash") == F.lag("hash").over(order), F.lit(False)))
    return step.select("event_id", "item_id", next_interval(F.col("unchanged"), F.col("interval")).alias("recrawl_after"), (F.col("t") + next_interval(F.col("unchanged"), F.col("interval"))).alias("due"))


def recrawl_intervals(crawls: DataFrame) -> DataFrame:
    """The interval after every crawl of an item: it doubles while the hash stays, up to eight weeks."""
    order = Window.partitionBy("item_id").orderBy("t", "event_id")
    step = crawls.withColumn("changed", F.coalesce((F.col("hash") != F.lag("hash").over(order)), F.lit(True)).cast("int"))
    step = step.withColumn("island", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("item_id", "island").orderBy("t", "event_id")) - 1
    return step.select("event_id", "item_id", F.least(F.lit(604800) * F.pow(F.lit(2), F.least(n, F.lit(10))), F.lit(4838400)).cast("long").alias("recrawl_after"))
