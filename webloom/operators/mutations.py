"""Changes to the catalogue as pure functions: old tables and a batch in, new tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import Scratch

PENDING_CAP = 500


def discovery_upsert(items: DataFrame, batch: DataFrame) -> DataFrame:
    """Items after discoveries (url, title, description): what is known stays, gaps fill, new rows come with inc 0."""
    order = Window.partitionBy("url").orderBy("position")
    merged = batch.withColumn("url", F.left("url", F.lit(767))).withColumns({
        "title": F.first("title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "description": F.first("description", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "r": F.row_number().over(order),
    }).where("r = 1").select("url", F.col("title").alias("t2"), F.col("description").alias("d2"))
    joined = items.join(merged, "url", "full")
    return joined.select("url", "item_id", F.coalesce("title", F.left("t2", F.lit(255))).alias("title"), F.coalesce("description", F.left("d2", F.lit(16000))).alias("description"), F.coalesce("inc", F.lit(0)).alias("inc"))


def admit(batch: DataFrame, dead: DataFrame, pending: DataFrame, known: DataFrame, cap: int = PENDING_CAP) -> DataFrame:
    """Discoveries that may enter: not dead, and new ones only while their host has room."""
    alive = batch.join(dead.select("url"), "url", "left_anti").join(known.select("url", F.lit(True).alias("known")), "url", "left")
    turn = Window.partitionBy("host", F.col("known").isNull()).orderBy("position", "url")
    ranked = alive.withColumn("r", F.row_number().over(turn)).join(pending, "host", "left")
    return ranked.where(F.col("known").isNotNull() | (F.col("r") <= cap - F.coalesce("pending", F.lit(0)))).select("url", "host", "position", F.col("known").isNull().alias("is_new"))


def upsert_hosts(hosts: DataFrame, batch: DataFrame) -> DataFrame:
    """Hosts after a batch (host, domain, n): inc grows, the domain is rewritten."""
    added = batch.groupBy("host").agg(F.sum("n").alias("n"), F.max("domain").alias("new_domain"))
    return hosts.join(added, "host", "full").select("host", F.coalesce("new_domain", "domain").alias("domain"), (F.coalesce("inc", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("inc"))


def insert_links(links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links after the batch (the first description wins) and the new ones."""
    first = Window.partitionBy("parent_id", "child_id").orderBy("position")
    fresh = batch.where("parent_id <> child_id").withColumn("r", F.row_number().over(first)).where("r = 1").select("parent_id", "child_id", F.left("description", F.lit(255)).alias("description"))
    fresh = fresh.join(links.select("parent_id", "child_id"), ["parent_id", "child_id"], "left_anti")
    return links.unionByName(fresh), fresh


def count_inbound(items: DataFrame, fresh: DataFrame) -> DataFrame:
    n = fresh.groupBy(F.col("child_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    return items.join(n, "item_id", "left").withColumn("inc", F.col("inc") + F.coalesce("n", F.lit(0))).drop("n")


def cascade_delete(items: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and links without the ids of ``gone`` at either end."""
    ids = gone.select("item_id").distinct()
    left = links.join(ids.withColumnRenamed("item_id", "parent_id"), "parent_id", "left_anti").join(ids.withColumnRenamed("item_id", "child_id"), "child_id", "left_anti")
    return items.join(ids, "item_id", "left_anti"), left


def last_survivors(survivors: DataFrame, most_rounds: int = 40) -> DataFrame:
    """old_id and the item at the end of its chain of merges (pointers double, so rounds grow with the logarithm of a chain).

    A cycle has no end; its members meet at its smallest id.
    """
    to = survivors.where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"), F.lit(None).cast("long").alias("low"))
    scratch, name = Scratch(survivors.sparkSession, "merges"), "step-0"
    to = scratch.save(to.withColumn("low", F.least("old_id", "new_id")), name)
    for turn in range(1, most_rounds + 1):
        onward = to.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("next"), F.col("low").alias("next_low"))
        step = to.join(onward, "new_id", "left")
        if not step.where("next is not null and (next <> new_id or next_low < low)").limit(1).count():
            break
        moved = step.select("old_id", F.coalesce("next", "new_id").alias("new_id"), F.least("low", "next_low").alias("low"))
        to = scratch.save(moved, f"step-{turn}")
        if turn > 1:
            scratch.drop(f"step-{turn - 2}")
    # whoever still points at a merged item is in a cycle or leads to one: the cycle's smallest id stays
    open_ends = to.select(F.col("old_id").alias("new_id"), F.lit(True).alias("again"))
    ends = to.join(open_ends, "new_id", "left").select("old_id", F.when(F.col("again"), F.col("low")).otherwise(F.col("new_id")).alias("new_id"))
    return ends.where("old_id <> new_id")


def merge_links(links: DataFrame, survivors: DataFrame) -> DataFrame:
    """Links after items merge (old_id -> new_id, already at the end of chains): ends move, self-links go.

    An edge that was between survivors before stays as it was; else the smallest description of those moved there.
    """
    to = lambda end: survivors.select(F.col("old_id").alias(end), F.col("new_id").alias(f"{end}_to"))
    moved = links.join(to("parent_id"), "parent_id", "left").join(to("child_id"), "child_id", "left")
    moved = moved.select(F.coalesce("parent_id_to", "parent_id").alias("p"), F.coalesce("child_id_to", "child_id").alias("c"), (F.col("parent_id_to").isNotNull() | F.col("child_id_to").isNotNull()).alias("new"), "description")
    first = F.min(F.struct("new", "description"))["description"]
    return moved.where("p <> c").groupBy(F.col("p").alias("parent_id"), F.col("c").alias("child_id")).agg(first.alias("description"))


@dataclass
class Catalogue:
    items: DataFrame  # item_id, url, host_id, priority
    links: DataFrame  # parent_id, child_id, description
    requests: DataFrame  # request_id, item_id
    aliases: DataFrame  # source_id, target_id
    dead: DataFrame  # url


def redirect(before: Catalogue, redirects: DataFrame) -> Catalogue:
    """The catalogue after redirects (item_id, new_url, new_host_id).

    The first item (smallest id) that redirects to a URL nobody has is renamed to it; every other
    one merges into the item that has the URL then, along chains to the end: the survivor takes the
    largest priority, the requests, the aliases (an interactive item leaves one of its own) and the
    links. Tombstones of the new URLs go.
    """
    wide = redirects.withColumn("new_url", F.left("new_url", F.lit(767)))
    stays = before.items.join(wide.select("item_id"), "item_id", "left_anti").select(F.col("url").alias("new_url"), F.col("item_id").alias("holder"))
    leaves = before.items.join(wide.select("item_id", F.col("new_url").alias("to")), "item_id").where("url = to").select(F.col("url").alias("new_url"), F.col("item_id").alias("holder"))
    held = stays.unionByName(leaves)
    first = wide.groupBy("new_url").agg(F.min("item_id").alias("first"))
    owner = first.join(held, "new_url", "left").select("new_url", F.coalesce("holder", "first").alias("owner"))
    told = wide.join(owner, "new_url")
    renamed = told.where("owner = item_id").select("item_id", "new_url", "new_host_id")
    gone = last_survivors(told.where("owner <> item_id").select(F.col("item_id").alias("old_id"), F.col("owner").alias("new_id")))
    promoted = before.items.join(gone.withColumnRenamed("old_id", "item_id"), "item_id").groupBy(F.col("new_id").alias("item_id")).agg(F.max("priority").alias("raised"))
    items = before.items.join(gone.select(F.col("old_id").alias("item_id")), "item_id", "left_anti").join(renamed, "item_id", "left").join(promoted, "item_id", "left")
    items = items.select("item_id", F.coalesce("new_url", "url").alias("url"), F.coalesce("new_host_id", "host_id").alias("host_id"), F.greatest("priority", F.coalesce("raised", F.lit(0))).alias("priority"))
    moved = lambda rows, c: rows.join(gone.select(F.col("old_id").alias(c), F.col("new_id").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    own = before.items.where("priority = 255").join(gone.withColumnRenamed("old_id", "item_id"), "item_id").select(F.col("item_id").alias("source_id"), F.col("new_id").alias("target_id"))
    aliases = moved(before.aliases, "target_id").join(own.select("source_id"), "source_id", "left_anti").select("source_id", "target_id").unionByName(own)
    dead = before.dead.join(wide.select(F.col("new_url").alias("url")), "url", "left_anti")
    return Catalogue(items, merge_links(before.links, gone), moved(before.requests, "item_id").select("request_id", "item_id"), aliases, dead)


def merge_plan(items: DataFrame, key: str) -> DataFrame:
    """item_id and survivor for every item: per ``key`` the crawled one, then the smallest id."""
    best = F.min(F.struct(F.col("crawled_time").isNull().alias("late"), F.col("item_id").alias("id")))
    groups = items.groupBy(key).agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    return items.select("item_id", key).join(groups, key).select("item_id", F.col("b.id").alias("survivor"), "n")


def mark_crawled(items: DataFrame, crawls: DataFrame, now: int) -> DataFrame:
    """Items after crawls (item_id, title, description, full_text as capped, type, noindex).

    Texts and type are cut to the widths of the store, the hash is of the stored text, the interval
    doubles where it stayed; the claim and the priority are given up. The texts are never broadcast:
    their size on disk says little about their size in memory.
    """
    new = crawls.select("item_id", F.left("title", F.lit(255)).alias("new_title"), F.left("description", F.lit(16000)).alias("new_description"), F.left("type", F.lit(255)).alias("new_type"), F.col("noindex").alias("new_noindex"), F.sha1(F.coalesce("full_text", F.lit("")).cast("binary")).alias("new_hash"))
    j = items.join(new.hint("shuffle_merge"), "item_id", "left")
    hit = F.col("new_hash").isNotNull()
    same = F.coalesce(F.col("content_hash") == F.col("new_hash"), F.lit(False))
    taken = [F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "description", "type", "noindex")]
    return j.select(
        "item_id", *taken,
        F.when(hit, F.when(same, F.least(F.col("recrawl_after") * 2, F.lit(4838400))).otherwise(604800)).otherwise(F.col("recrawl_after")).alias("recrawl_after"),
        F.when(hit, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(hit, F.lit(now)).otherwise(F.col("crawled_time")).alias("crawled_time"), F.when(hit, 0).otherwise(F.col("priority")).alias("priority"),
        F.when(~hit, F.col("claimed_until")).alias("claimed_until"),
    )


def enqueue(items: DataFrame, requested: DataFrame, dead: DataFrame, now: int, wait: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, requests and tombstones after interactive requests (url).

    An item asked for has priority 255, is uncrawled and unclaimed; a URL that no item has becomes
    a new item (without an id yet); a tombstone of the URL is forgotten.
    """
    urls = requested.select(F.left("url", F.lit(767)).alias("url")).distinct()
    j = items.join(urls.withColumn("asked", F.lit(True)), "url", "full")
    changed = j.withColumns({"priority": F.when(F.col("asked"), F.greatest(F.coalesce("priority", F.lit(0)), F.lit(255))).otherwise(F.col("priority")), "crawled_time": F.when(F.col("asked").isNull(), F.col("crawled_time")), "claimed_until": F.when(F.col("asked").isNull(), F.col("claimed_until"))}).drop("asked")
    return changed, urls.select("url", F.lit(now + wait).alias("deadline"), F.lit(None).cast("string").alias("failure")), forget(dead, urls)


def forget(dead: DataFrame, urls: DataFrame) -> DataFrame:
    """Tombstones without those of ``urls``."""
    return dead.join(urls.select("url").distinct(), "url", "left_anti")


def delete(items: DataFrame, links: DataFrame, dead: DataFrame, gone: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, links and tombstones after deletions (item_id, reason: null leaves no tombstone)."""
    left, edges = cascade_delete(items, links, gone)
    marks = items.join(gone.where("reason is not null").select("item_id", "reason"), "item_id").select("url", "reason", F.lit(now).cast("long").alias("dead_time"))
    return left, edges, dead_upsert(dead, marks)


def claim(items: DataFrame, hosts: DataFrame, picks: DataFrame, now: int, claim: int = 300, pause: int = 60) -> tuple[DataFrame, DataFrame]:
    """Items and hosts after picks (item_id, host_id, priority): claimed, and the hosts of ordinary picks reserved."""
    held = picks.select("item_id", F.lit(True).alias("picked"))
    own = items.join(held, "item_id", "left").withColumn("claimed_until", F.when(F.col("picked"), F.lit(now + claim)).otherwise(F.col("claimed_until"))).drop("picked")
    busy = picks.where("priority = 0").select("host_id", F.lit(True).alias("busy")).distinct()
    return own, hosts.join(busy, "host_id", "left").withColumn("next_crawl", F.when(F.col("busy"), F.lit(now + pause)).otherwise(F.col("next_crawl"))).drop("busy")


def fail_requests(items: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Items and requests after expiry: a request past its deadline fails, its item's priority ends unless another request lives."""
    over = F.col("failure").isNull() & (F.col("deadline") <= now)
    alive = requests.where(F.col("failure").isNull() & (F.col("deadline") > now)).select("item_id").distinct()
    drop = requests.where(over).select("item_id").distinct().join(alive, "item_id", "left_anti").withColumn("drop", F.lit(True))
    ended = items.join(drop, "item_id", "left").withColumn("priority", F.when(F.col("drop"), 0).otherwise(F.col("priority"))).drop("drop")
    return ended, requests.withColumn("failure", F.when(over, "expired").otherwise(F.col("failure")))


def dead_upsert(dead: DataFrame, batch: DataFrame) -> DataFrame:
    """Tombstones after a batch; a repeated one restarts its clock."""
    all_ = dead.unionByName(batch)
    return all_.groupBy(F.left("url", F.lit(767)).alias("url")).agg(F.max_by("reason", "dead_time").alias("reason"), F.max("dead_time").alias("dead_time"))


def dead_alive(dead: DataFrame, now: int, ttl: int = 90 * 86400) -> DataFrame:
    return dead.where(F.lit(now) - F.col("dead_time") < ttl)


def latest(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Key-value settings after all writes: the last one of each key."""
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value))


def domain_revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many hosts changed their domain (exactly compared): the revision grows by it."""
    j = before.select("host_id", F.col("domain").alias("was")).join(after.select("host_id", "domain"), "host_id")
    return j.agg(F.count_if(~F.col("was").eqNullSafe(F.col("domain"))).alias("bumps"))


def coalesce_queue(requests: DataFrame) -> DataFrame:
    """Index requests by item: code 1 beats 2 beats 0; the generation counts the requests."""
    code = lambda c: F.coalesce(F.min(F.when(F.col(c) > 0, F.col(c))), F.lit(0)).alias(c)
    return requests.groupBy("item_id").agg(code("sync_item"), code("sync_links"), F.count(F.lit(1)).alias("generation"))


def settle_queue(queue: DataFrame, drained: DataFrame) -> DataFrame:
    """What stays queued after ``drained`` (item_id, generation) was worked on: rows that were asked for again since."""
    done = drained.select("item_id", F.col("generation").alias("seen"))
    return queue.join(done, "item_id", "left").where(F.col("seen").isNull() | (F.col("seen") != F.col("generation"))).drop("seen")
