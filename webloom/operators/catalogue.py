"""Lookups, joins and aggregates over the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators import predicates


def edge_enrichment(links: DataFrame, parents: DataFrame, item_host: DataFrame, hosts: DataFrame) -> DataFrame:
    """Every edge with its packed id, the parent's domain and whether it leaves the child's domain."""
    child = item_host.join(hosts.select("host_id", F.col("domain").alias("child_domain")), "host_id").select(F.col("item_id").alias("child_id"), "child_domain")
    parent = parents.select(F.col("item_id").alias("parent_id"), "domain")
    joined = links.join(parent, "parent_id").join(child, "child_id")
    return joined.select(predicates.packed_edge(F.col("parent_id"), F.col("child_id")).alias("id"), "parent_id", "child_id", "domain", (F.col("domain") != F.col("child_domain")).cast("int").alias("external"), "description")


def inbound_counts(items: DataFrame, links: DataFrame) -> DataFrame:
    counted = links.groupBy(F.col("child_id").alias("item_id")).agg(F.count(F.lit(1)).alias("inc"))
    return items.join(counted, "item_id", "left").select("item_id", F.coalesce("inc", F.lit(0)).alias("inc"))


def referrer(links: DataFrame, known: DataFrame) -> DataFrame:
    """One parent for each child: the smallest id that the catalogue has."""
    return links.join(known.select(F.col("item_id").alias("parent_id")), "parent_id", "left_semi").groupBy(F.col("child_id").alias("item_id")).agg(F.min("parent_id").alias("parent_id"))


def item_preview(items: DataFrame, referrers: DataFrame) -> DataFrame:
    return items.where(predicates.presentable()).join(referrers, "item_id", "left").select("item_id", "title", "description", "crawled_time", "parent_id")


def stale_revisions(items: DataFrame, indexed: DataFrame, revision: int) -> DataFrame:
    return items.join(indexed, "item_id", "left").where(F.col("revision").isNull() | (F.col("revision") != revision)).select("item_id")


def live(requests: DataFrame, now: int) -> DataFrame:
    return requests.where(F.col("failure").isNull() & (F.col("deadline") > now))


def live_items(items: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    return items.join(live(requests, now).select("item_id"), "item_id", "left_semi")


def expire_requests(requests: DataFrame, now: int) -> DataFrame:
    """Requests past their deadline, and whether their item loses its priority."""
    expired = requests.where(F.col("failure").isNull() & (F.col("deadline") <= now))
    other = live(requests, now).select("item_id", F.lit(0).alias("keeps")).distinct()
    return expired.join(other, "item_id", "left").select("request_id", "item_id", F.lit("expired").alias("failure"), F.coalesce("keeps", F.lit(1)).alias("drop_priority"))


def resolve_aliases(asked: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    direct = items.select("item_id", F.col("item_id").alias("direct"))
    via = aliases.select(F.col("source_id").alias("item_id"), "target_id")
    return asked.join(direct, "item_id", "left").join(via, "item_id", "left").select("item_id", F.coalesce("direct", "target_id").alias("resolved"))


def new_edges(requested: DataFrame, existing: DataFrame) -> DataFrame:
    return requested.where("parent_id <> child_id").join(existing, ["parent_id", "child_id"], "left_anti")


def presence_diff(index: DataFrame, store: DataFrame) -> DataFrame:
    """What the index must do: delete rows that the store lacks, sync rows whose inc differs or that it lacks."""
    both = index.select("item_id", F.col("inc").alias("was"), F.lit(True).alias("there")).join(store.select("item_id", "inc", F.lit(True).alias("stored")), "item_id", "full")
    action = F.when(F.col("stored").isNull(), "delete").when(F.col("there").isNull() | ~F.col("was").eqNullSafe(F.col("inc")), "full")
    return both.select("item_id", action.alias("action")).where("action is not null")


def union_ids(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists).where("id > 0").distinct()


def _counters(sign=None):
    sign = F.lit(1) if sign is None else sign
    crawled, image = F.col("crawled_time").isNotNull(), predicates.is_image(F.col("type"))
    add = lambda c: F.coalesce(F.sum(F.when(c, sign).otherwise(0)), F.lit(0)).cast("long")
    return (
        add(F.lit(True)).alias("found"), add(crawled).alias("indexed"), add(predicates.searchable()).alias("searchable"),
        add(~crawled).alias("queued"), add(crawled & ~image).alias("pages"), add(crawled & image).alias("images"),
    )


def totals(items: DataFrame, hosts: DataFrame, dead: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return items.agg(*_counters()).crossJoin(one(hosts, "hosts")).crossJoin(one(dead, "dead"))  # three rows of one


def counter_deltas(log: DataFrame) -> DataFrame:
    """Counters from a change log: rows before a change count -1, rows after it +1 (column sign)."""
    return log.agg(*_counters(F.col("sign")))


def pending_per_host(frontier: DataFrame) -> DataFrame:
    return frontier.where(F.col("crawled_time").isNull()).groupBy("host_id").agg(F.count(F.lit(1)).alias("pending"))


def keyset_page(rows: DataFrame, keys: tuple[str, str], cursor: tuple, size: int) -> DataFrame:
    a, b = keys
    return rows.where((F.col(a) > cursor[0]) | ((F.col(a) == cursor[0]) & (F.col(b) > cursor[1]))).orderBy(a, b).limit(size)


def feed(items: DataFrame, since: int | None, size: int = 50) -> DataFrame:
    """The newest items in ascending order, or the next ones from the inclusive cursor ``since``."""
    crawled = items.where(F.col("crawled_time").isNotNull())
    if since is None:
        return crawled.orderBy(F.desc("crawled_time"), F.desc("item_id")).limit(size).orderBy("crawled_time", "item_id")
    return crawled.where(F.col("crawled_time") >= since).orderBy("crawled_time", "item_id").limit(size)


def focused_pick(candidates: DataFrame, items: DataFrame, size: int) -> DataFrame:
    eligible = items.where(F.col("crawled_time").isNull()).select(F.col("item_id").alias("child_id"))
    return candidates.join(eligible, "child_id").orderBy(F.desc("score"), "child_id").limit(size).select(F.col("child_id").alias("item_id"), "score")


def first_per_group(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
