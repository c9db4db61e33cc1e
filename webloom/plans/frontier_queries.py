"""Frontier, mutation, rate-limit and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.operators import frontier, mutations, predicates
from webloom.plans.registry import query
from webloom.plans.views import NOW, view, with_views
from webloom.session import table

_READY = f"(priority > 0 OR next_crawl IS NULL OR next_crawl <= {NOW})"
_FRESH = f"SELECT item_id, host_id, priority, 0 AS class, CAST(-priority AS BIGINT) AS k FROM frontier WHERE crawled_time IS NULL AND claimed_until IS NULL AND {_READY}"
_RECRAWL = f"SELECT item_id, host_id, priority, 1 AS class, CAST(crawled_time + recrawl_after AS BIGINT) AS k FROM frontier WHERE crawled_time + recrawl_after <= {NOW} AND (claimed_until IS NULL OR claimed_until <= {NOW}) AND {_READY}"
_STALLED = f"SELECT item_id, host_id, priority, 2 AS class, CAST(0 AS BIGINT) AS k FROM frontier WHERE crawled_time IS NULL AND claimed_until <= {NOW} AND {_READY}"


def _picks(name: str, sql: str, f) -> None:
    query(name, with_views(f"SELECT * FROM ({sql}) ORDER BY class, k, item_id LIMIT 100", "frontier"))(lambda spark, d: frontier.pick(f(view(spark, d, "frontier"), NOW), 100))


_picks("fresh_pick", _FRESH, frontier.fresh)
_picks("recrawl_pick", _RECRAWL, frontier.recrawl)
_picks("stalled_pick", _STALLED, frontier.stalled)


@query("interactive_pick", with_views(f"SELECT item_id, host_id FROM frontier WHERE priority > 0 AND crawled_time IS NULL AND (claimed_until IS NULL OR claimed_until <= {NOW}) AND item_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) ORDER BY item_id LIMIT 50", "frontier"))
def interactive_pick(spark, d):
    live = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("item_id"))
    return frontier.interactive(view(spark, d, "frontier"), live, NOW, 50)


@query("frontier_batch", with_views(f", r AS ({_FRESH} UNION ALL {_RECRAWL} UNION ALL {_STALLED}), f AS (SELECT *, row_number() OVER (PARTITION BY host_id, priority > 0 ORDER BY class, k, item_id) AS n FROM r) SELECT item_id, host_id, priority, class, k FROM f WHERE priority > 0 OR n = 1 ORDER BY class, k, item_id LIMIT 500", "frontier"))
def frontier_batch(spark, d):
    return frontier.batch(view(spark, d, "frontier"), NOW, 500)


@query("backoff_schedule", with_views(", e AS (SELECT event_id, identifier AS host_id, t, bucket <> 'error' AND bucket <> 'click' AS ok FROM requests), i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY host_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e), f AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum(CAST(NOT ok AS INT)) OVER (PARTITION BY host_id, island ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) END AS failures FROM i) SELECT event_id, host_id, CAST(failures AS BIGINT) AS failures, CAST(CASE WHEN failures > 0 THEN least(300 * pow(2, least(failures - 1, 20)), 604800) ELSE 0 END AS BIGINT) AS pause FROM f", "requests"))
def backoff_schedule(spark, d):
    rows = view(spark, d, "requests")
    return frontier.backoff(rows.select("event_id", F.col("identifier").alias("host_id"), "t", (~F.col("bucket").isin("error", "click")).alias("ok")))


@query("next_crawl", f"SELECT s_suppkey AS host_id, {NOW} + greatest(CASE WHEN s_suppkey % 4 = 0 THEN 300 ELSE 60 END, greatest(60, least(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey * 50 END, 60), 3600))) AS next_crawl FROM supplier")
def next_crawl(spark, d):
    s = table(spark, d, "supplier")
    status = F.when(F.col("s_suppkey") % 4 == 0, 429).otherwise(200)
    delay = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") * 50)
    return s.select(F.col("s_suppkey").alias("host_id"), predicates.next_crawl_after(F.lit(NOW), status, delay).alias("next_crawl"))


_CRAWLS = ", c AS (SELECT event_id, identifier AS item_id, t, bucket AS hash, 604800 * (1 + event_id % 9) AS \"interval\" FROM requests)"


def _crawls(spark, d):
    return view(spark, d, "requests").select("event_id", F.col("identifier").alias("item_id"), "t", F.col("bucket").alias("hash"), (F.lit(604800) * (1 + F.col("event_id") % 9)).alias("interval"))


_NEXT = "CASE WHEN hash = lag(hash) OVER (PARTITION BY item_id ORDER BY t, event_id) THEN least(\"interval\" * 2, 4838400) ELSE 604800 END"


@query("adaptive_recrawl", with_views(f"{_CRAWLS} SELECT event_id, item_id, {_NEXT} AS recrawl_after, t + {_NEXT} AS due FROM c", "requests"))
def adaptive_recrawl(spark, d):
    return frontier.recrawl_step(_crawls(spark, d))


@query("recrawl_intervals", with_views(f"{_CRAWLS}, s AS (SELECT *, coalesce(CAST(hash <> lag(hash) OVER w AS INT), 1) AS changed FROM c WINDOW w AS (PARTITION BY item_id ORDER BY t, event_id)), i AS (SELECT *, sum(changed) OVER (PARTITION BY item_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT event_id, item_id, CAST(least(604800 * pow(2, least(row_number() OVER (PARTITION BY item_id, island ORDER BY t, event_id) - 1, 10)), 4838400) AS BIGINT) AS recrawl_after FROM i", "requests"))
def recrawl_intervals(spark, d):
    return frontier.recrawl_intervals(_crawls(spark, d))


@query("rate_limit", with_views("SELECT bucket, identifier, t // 86400 * 86400 AS window_start, count(*) AS requests, CASE WHEN count(*) > 5 THEN 1 ELSE 0 END AS over_limit FROM requests GROUP BY ALL", "requests"))
def rate_limit(spark, d):
    return view(spark, d, "requests").groupBy("bucket", "identifier", predicates.window_start(F.col("t"), 86400).alias("window_start")).agg(F.count(F.lit(1)).alias("requests"), (F.count(F.lit(1)) > 5).cast("int").alias("over_limit"))


@query("rate_retry_after", with_views("SELECT event_id, greatest(1, t // 60 * 60 + 60 - t) AS retry_after FROM requests", "requests"))
def rate_retry_after(spark, d):
    return view(spark, d, "requests").select("event_id", predicates.retry_after(F.col("t")).alias("retry_after"))


_QUEUE = "q AS (SELECT l_partkey AS item_id, l_linenumber % 3 AS sync_item, CAST(l_suppkey % 3 AS INT) AS sync_links FROM lineitem)"
_COALESCED = f"WITH {_QUEUE} SELECT item_id, coalesce(min(nullif(sync_item, 0)), 0) AS sync_item, coalesce(min(nullif(sync_links, 0)), 0) AS sync_links, count(*) AS generation FROM q GROUP BY item_id"


def _queue(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), (F.col("l_linenumber") % 3).alias("sync_item"), (F.col("l_suppkey") % 3).cast("int").alias("sync_links"))


query("queue_coalesce", _COALESCED)(lambda spark, d: mutations.coalesce_queue(_queue(spark, d)))
query("queue_drain", _COALESCED + " ORDER BY item_id LIMIT 1000")(lambda spark, d: mutations.coalesce_queue(_queue(spark, d)).orderBy("item_id").limit(1000))


@query("pending_cap", "WITH b AS (SELECT 'u' || l_orderkey || '-' || l_linenumber AS url, l_suppkey AS host, l_orderkey AS position FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY position, url) AS r FROM b WHERE position % 10 <> 0) SELECT url, host, position, TRUE AS is_new FROM n WHERE r <= 500 - coalesce((SELECT CASE WHEN host % 2 = 0 THEN 400 END), 0)")
def pending_cap(spark, d):
    line = table(spark, d, "lineitem")
    batch = line.select(F.concat(F.lit("u"), "l_orderkey", F.lit("-"), "l_linenumber").alias("url"), F.col("l_suppkey").alias("host"), F.col("l_orderkey").alias("position"))
    pending = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("host"), F.lit(400).alias("pending"))
    return mutations.admit(batch, batch.where("position % 10 = 0"), pending, batch.where("false"))


@query("host_upsert", "SELECT s_name AS host, CASE WHEN n IS NULL THEN CAST(s_nationkey AS VARCHAR) ELSE 'new' END AS domain, CAST(s_suppkey + coalesce(n, 0) AS BIGINT) AS inc FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 6 AND l_suppkey % 3 <> 0 GROUP BY 1) ON l_suppkey = s_suppkey")
def host_upsert(spark, d):
    s = table(spark, d, "supplier")
    hosts = s.select(F.col("s_name").alias("host"), F.col("s_nationkey").cast("string").alias("domain"), F.col("s_suppkey").alias("inc"))
    batch = table(spark, d, "lineitem").where("l_linenumber <= 6 and l_suppkey % 3 <> 0").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("host"), F.lit("new").alias("domain"), F.lit(1).alias("n"))
    return mutations.upsert_hosts(hosts, batch)


@query("discovery_upsert", "WITH b AS (SELECT 'p' || (l_partkey + 500) AS url, min(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_returnflag END ORDER BY l_orderkey) AS x, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY 1) SELECT coalesce(i.url, b.url) AS url, i.item_id, coalesce(i.title, b.s) AS title, coalesce(i.inc, 0) AS inc FROM (SELECT 'p' || p_partkey AS url, p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title, p_size AS inc FROM part) i FULL JOIN b ON i.url = b.url")
def discovery_upsert(spark, d):
    items = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("url"), F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("title"), F.lit(None).cast("string").alias("description"), F.col("p_size").alias("inc"))
    batch = table(spark, d, "lineitem").select(F.concat(F.lit("p"), (F.col("l_partkey") + 500)).alias("url"), F.col("l_linestatus").alias("title"), F.lit(None).cast("string").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return mutations.discovery_upsert(items, batch).drop("description")


@query("link_insert", with_views("SELECT parent_id, child_id, description FROM links WHERE parent_id <> child_id AND NOT (parent_id % 3 = 0)", "links"))
def link_insert(spark, d):
    links = view(spark, d, "links")
    return mutations.insert_links(links.where("parent_id % 3 = 0"), links.withColumn("position", F.lit(1)))[1]


@query("count_inbound", with_views("SELECT i.item_id, i.inc + coalesce(n, 0) AS inc FROM items i LEFT JOIN (SELECT child_id, count(*) AS n FROM links WHERE parent_id % 3 = 0 GROUP BY 1) ON child_id = i.item_id", "items", "links"))
def count_inbound(spark, d):
    return mutations.count_inbound(view(spark, d, "items").select("item_id", "inc"), view(spark, d, "links").where("parent_id % 3 = 0"))


@query("cascade_delete", with_views("SELECT parent_id, child_id FROM links WHERE parent_id % 7 <> 0 AND child_id % 7 <> 0", "links"))
def cascade_delete(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    return mutations.cascade_delete(items, view(spark, d, "links"), table(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("item_id")))[1].select("parent_id", "child_id")


_CHAIN = "CASE {0} % 10 WHEN 3 THEN {0} - 1 WHEN 4 THEN {0} - 2 WHEN 5 THEN {0} - 3 ELSE {0} END"


@query("redirect_merge", with_views(f", m AS (SELECT {_CHAIN.format('parent_id')} AS p, {_CHAIN.format('child_id')} AS c, parent_id, child_id, description FROM links) SELECT p AS parent_id, c AS child_id, coalesce(min(description) FILTER (WHERE p = parent_id AND c = child_id), min(description)) AS description FROM m WHERE p <> c GROUP BY 1, 2", "links"))
def redirect_merge(spark, d):
    """Links after merges along chains: ids that end in 5, 4 and 3 redirect to the one before."""
    links = view(spark, d, "links")
    last = F.greatest(*(F.lit(r[0]) for r in links.agg(F.greatest(F.max("parent_id"), F.max("child_id"))).collect()), F.lit(0))
    old = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("old_id")).where("old_id % 10 in (3, 4, 5)")
    return mutations.merge_links(links, mutations.last_survivors(old.withColumn("new_id", F.col("old_id") - 1)))


_REDIRECTS = """o AS (SELECT o_orderkey AS item_id, 'u' || o_orderkey AS url, o_custkey AS host_id, CASE WHEN o_orderkey % 3 = 0 THEN 255 ELSE 0 END AS priority FROM orders),
  r AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 8 = 1 THEN 'u' || (o_orderkey - 1) ELSE 'new' || (o_orderkey // 64) END AS new_url FROM orders WHERE o_orderkey % 8 IN (1, 2)),
  f AS (SELECT new_url, min(item_id) AS first FROM r GROUP BY 1),
  w AS (SELECT r.item_id, r.new_url, coalesce(o.item_id, f.first) AS owner FROM r JOIN f USING (new_url) LEFT JOIN o ON o.url = r.new_url),
  g AS (SELECT item_id AS old_id, owner AS new_id FROM w WHERE owner <> item_id)"""


def _redirected(spark, d):
    """Every eighth item redirects to the one before (or to a free URL, where there is none), every next one to a URL that many share."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    items = o.select(k.alias("item_id"), F.concat(F.lit("u"), k).alias("url"), F.col("o_custkey").alias("host_id"), F.when(k % 3 == 0, 255).otherwise(0).alias("priority"))
    to = o.where((k % 8).isin(1, 2)).select(k.alias("item_id"), F.when(k % 8 == 1, F.concat(F.lit("u"), k - 1)).otherwise(F.concat(F.lit("new"), F.floor(k / 64))).alias("new_url"), F.lit(-1).cast("long").alias("new_host_id"))
    requests = o.select((k + 7).alias("request_id"), k.alias("item_id"))
    aliases = o.where(k % 5 == 0).select((-k).alias("source_id"), k.alias("target_id"))
    return mutations.redirect(mutations.Catalogue(items, view(spark, d, "links"), requests, aliases, o.select(F.concat(F.lit("u"), k - 1).alias("url"))), to)


@query("redirect_items", f"WITH {_REDIRECTS}, p AS (SELECT g.new_id AS item_id, max(o.priority) AS raised FROM g JOIN o ON o.item_id = g.old_id GROUP BY 1) SELECT o.item_id, coalesce(w.new_url, o.url) AS url, CASE WHEN w.item_id IS NULL THEN o.host_id ELSE -1 END AS host_id, greatest(o.priority, coalesce(p.raised, 0)) AS priority FROM o LEFT JOIN w ON w.item_id = o.item_id AND w.owner = o.item_id LEFT JOIN p ON p.item_id = o.item_id WHERE o.item_id NOT IN (SELECT old_id FROM g)")
def redirect_items(spark, d):
    return _redirected(spark, d).items


@query("redirect_requests", f"WITH {_REDIRECTS} SELECT o_orderkey + 7 AS request_id, coalesce(g.new_id, o_orderkey) AS item_id FROM orders LEFT JOIN g ON g.old_id = o_orderkey")
def redirect_requests(spark, d):
    return _redirected(spark, d).requests


@query("redirect_aliases", f"WITH {_REDIRECTS} SELECT -o_orderkey AS source_id, coalesce(g.new_id, o_orderkey) AS target_id FROM orders LEFT JOIN g ON g.old_id = o_orderkey WHERE o_orderkey % 5 = 0 UNION ALL SELECT g.old_id, g.new_id FROM g JOIN o ON o.item_id = g.old_id WHERE o.priority = 255")
def redirect_aliases(spark, d):
    return _redirected(spark, d).aliases


@query("redirect_dead", f"WITH {_REDIRECTS} SELECT 'u' || (o_orderkey - 1) AS url FROM orders WHERE 'u' || (o_orderkey - 1) NOT IN (SELECT new_url FROM r)")
def redirect_dead(spark, d):
    return _redirected(spark, d).dead


@query("url_merge_plan", with_views(", g AS (SELECT *, 'https://example.com/p/' || (item_id // 3) AS key FROM items) SELECT item_id, first_value(item_id) OVER (PARTITION BY key ORDER BY (crawled_time IS NULL), item_id) AS survivor, count(*) OVER (PARTITION BY key) AS n FROM g", "items"))
def url_merge_plan(spark, d):
    """Items whose URLs have one canonical form: spellings of the same address by threes."""
    n = F.col("item_id") % 3
    spelt = F.concat(F.when(n == 0, "HTTPS://Example.com:443").when(n == 1, "http://example.com").otherwise("https://x@example.com"), F.lit("/p/"), F.floor(F.col("item_id") / 3), F.when(n == 2, "?utm_source=a#b").otherwise(""))
    return mutations.merge_plan(view(spark, d, "items").withColumn("key", urls.canonical_url(spelt)), "key")


@query("url_merge_links", with_views(", s AS (SELECT item_id, first_value(item_id) OVER (PARTITION BY item_id // 3 ORDER BY (crawled_time IS NULL), item_id) AS survivor FROM items), m AS (SELECT l.parent_id, coalesce(s.survivor, l.child_id) AS c, l.child_id, l.description FROM links l LEFT JOIN s ON s.item_id = l.child_id) SELECT parent_id, c AS child_id, coalesce(min(description) FILTER (WHERE c = child_id), min(description)) AS description FROM m WHERE parent_id <> c GROUP BY 1, 2", "items", "links"))
def url_merge_links(spark, d):
    """The plan applied to the children of links."""
    plan = url_merge_plan(spark, d).where("survivor <> item_id").select(F.col("item_id").alias("child_id"), F.col("survivor").alias("to"))
    links = view(spark, d, "links").join(plan, "child_id", "left")
    moved = links.select("parent_id", F.coalesce("to", "child_id").alias("child_id"), F.col("to").isNotNull().alias("new"), "description").where("parent_id <> child_id")
    return moved.groupBy("parent_id", "child_id").agg(F.min(F.struct("new", "description"))["description"].alias("description"))


@query("mark_crawled", "SELECT p_partkey AS item_id, CASE WHEN hit THEN 'crawled' ELSE p_name END AS title, CASE WHEN hit THEN left(repeat(p_type, 2000), 16000) END AS description, CASE WHEN hit THEN 'text/html' END AS type, CASE WHEN hit THEN p_partkey % 2 END AS noindex, CASE WHEN hit THEN CASE WHEN p_partkey % 2 = 0 THEN least(p_partkey * 10000 * 2, 4838400) ELSE 604800 END ELSE p_partkey * 10000 END AS recrawl_after, CASE WHEN hit OR p_partkey % 2 = 0 THEN sha1(p_brand) ELSE 'x' END AS content_hash, CASE WHEN hit THEN 820454400 END AS crawled_time, CASE WHEN hit THEN 0 ELSE 255 END AS priority, CASE WHEN NOT hit THEN 7 END AS claimed_until FROM (SELECT *, p_partkey % 3 = 0 AS hit FROM part)")
def mark_crawled(spark, d):
    part = table(spark, d, "part")
    blank = {"description": "string", "type": "string", "noindex": "long", "crawled_time": "int"}
    items = part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), (F.col("p_partkey") * 10000).alias("recrawl_after"), F.when(F.col("p_partkey") % 2 == 0, F.sha1(F.col("p_brand").cast("binary"))).otherwise("x").alias("content_hash"), F.lit(255).alias("priority"), F.lit(7).alias("claimed_until"), *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))
    crawls = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item_id"), F.lit("crawled").alias("title"), F.repeat("p_type", F.lit(2000)).alias("description"), F.col("p_brand").alias("full_text"), F.lit("text/html").alias("type"), (F.col("p_partkey") % 2).alias("noindex"))
    return mutations.mark_crawled(items, crawls, NOW)


_CLASSES = f"""z AS (SELECT item_id, host_id, priority, -2 AS class, CAST(item_id AS BIGINT) AS k FROM frontier WHERE priority > 0 AND crawled_time IS NULL AND (claimed_until IS NULL OR claimed_until <= {NOW}) AND item_id % 4 = 0
  UNION ALL SELECT item_id, host_id, priority, -1, -(item_id % 1000) FROM ({_FRESH}) WHERE item_id % 7 = 0 UNION ALL {_FRESH} UNION ALL {_RECRAWL} UNION ALL {_STALLED}),
  y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY class, k) AS b FROM z), x AS (SELECT item_id, host_id, priority, class, k, CASE WHEN priority = 0 THEN row_number() OVER (PARTITION BY host_id, priority > 0 ORDER BY class, k, item_id) ELSE 1 END AS r FROM y WHERE b = 1)"""


def _full(spark, d):
    f = view(spark, d, "frontier")
    focused = f.where("item_id % 7 = 0").select("item_id", (F.col("item_id") % 1000).alias("score"))
    return f, frontier.full_batch(f, f.where("item_id % 4 = 0"), focused, NOW, 400)


_FULL = f", {_CLASSES}, picks AS (SELECT item_id, host_id, priority, class, k FROM x WHERE r = 1 ORDER BY class, k, item_id LIMIT 400)"


@query("full_batch", with_views(f"{_FULL} SELECT * FROM picks", "frontier"))
def full_batch(spark, d):
    """Interactive, focused, fresh, recrawl and stalled picks in one order."""
    return _full(spark, d)[1]


@query("claim_items", with_views(f"{_FULL} SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM picks) THEN {NOW} + 300 ELSE claimed_until END AS claimed_until FROM frontier", "frontier"))
def claim_items(spark, d):
    """Claims that the picks leave behind."""
    f, picks = _full(spark, d)
    hosts = f.select("host_id", "next_crawl").distinct()
    return mutations.claim(f.select("item_id", "claimed_until"), hosts, picks, NOW)[0]


@query("reserve_hosts", with_views(f"{_FULL} SELECT DISTINCT host_id, CASE WHEN host_id IN (SELECT host_id FROM picks WHERE priority = 0) THEN {NOW} + 60 ELSE next_crawl END AS next_crawl FROM frontier", "frontier"))
def reserve_hosts(spark, d):
    f, picks = _full(spark, d)
    return mutations.claim(f.select("item_id", "claimed_until"), f.select("host_id", "next_crawl").distinct(), picks, NOW)[1]


@query("stalled_join", with_views(f", h AS (SELECT DISTINCT host_id, next_crawl FROM frontier) SELECT f.item_id, h.host_id FROM h JOIN frontier f ON f.host_id = h.host_id AND f.crawled_time IS NULL AND f.claimed_until <= {NOW} WHERE f.priority > 0 OR h.next_crawl IS NULL OR h.next_crawl <= {NOW}", "frontier"))
def stalled_join(spark, d):
    """Items meet a host table of their own; the claim is part of the join."""
    f = view(spark, d, "frontier")
    items, hosts = f.drop("next_crawl"), f.select("host_id", "next_crawl").distinct()
    return frontier.with_hosts(items, hosts, F.col("crawled_time").isNull() & (F.col("claimed_until") <= NOW)).where(predicates.host_ready(NOW)).select("item_id", "host_id")


@query("expire_items", f"SELECT p_partkey AS item_id, CASE WHEN e.item_id IS NOT NULL AND l.item_id IS NULL THEN 0 ELSE 255 END AS priority FROM part LEFT JOIN (SELECT DISTINCT o_orderkey % 700 AS item_id FROM orders WHERE o_orderkey % 9 <> 0 AND (o_orderkey * 53) % 240 - 120 <= 0) e ON e.item_id = p_partkey LEFT JOIN (SELECT DISTINCT o_orderkey % 700 AS item_id FROM orders WHERE o_orderkey % 9 <> 0 AND (o_orderkey * 53) % 240 - 120 > 118) l ON l.item_id = p_partkey".replace("> 118)", "> 0)"))
def expire_items(spark, d):
    k = F.col("o_orderkey")
    requests = table(spark, d, "orders").select(k.alias("request_id"), (k % 700).alias("item_id"), (F.lit(NOW) + (k * 53) % 240 - 120).alias("deadline"), F.when(k % 9 == 0, "timeout").alias("failure"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.lit(255).alias("priority"))
    return mutations.fail_requests(items, requests, NOW)[0]


@query("delete_with_tombstones", f"SELECT 'u' || p_partkey AS url, CASE WHEN p_partkey % 14 = 0 THEN 'gone' ELSE 'old' END AS reason, CASE WHEN p_partkey % 14 = 0 THEN {NOW} ELSE p_partkey END AS dead_time FROM part WHERE p_partkey % 14 = 0 OR p_partkey % 5 = 0")
def delete_with_tombstones(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    items = part.select(k.alias("item_id"), F.concat(F.lit("u"), k).alias("url"))
    dead = part.where(k % 5 == 0).select(F.concat(F.lit("u"), k).alias("url"), F.lit("old").alias("reason"), k.cast("long").alias("dead_time"))
    return mutations.delete(items, view(spark, d, "links"), dead, part.where(k % 7 == 0).select(k.alias("item_id"), F.when(k % 2 == 0, "gone").alias("reason")), NOW)[2]


@query("domain_backfill", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE 'b' || (s_suppkey % 7) || '.co.uk' END AS domain FROM supplier")
def domain_backfill(spark, d):
    """Hosts without a domain get their registrable one; each host name is worked out once."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("www.b"), F.col("s_suppkey") % 7, F.lit(".co.uk")).alias("host"), F.when(F.col("s_suppkey") % 2 == 0, "kept").alias("domain"))
    known = urls.registrable_domains(s.where("domain is null"), "host", spark.createDataFrame([(r,) for r in urls.SUFFIXES], "rule string")).withColumnRenamed("domain", "found")
    return s.join(known, "host", "left").select("s_suppkey", F.coalesce("domain", "found").alias("domain"))


_ENQUEUE = "FROM (SELECT 'u' || o_orderkey AS url, * FROM orders) FULL JOIN (SELECT DISTINCT 'u' || (o_orderkey + 3) AS asked FROM orders WHERE o_orderkey % 6 = 0) ON url = asked"


def _enqueued(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("url", F.concat(F.lit("u"), k))
    items = o.select("url", k.alias("item_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 255).otherwise(0).alias("priority"), k.alias("crawled_time"), k.alias("claimed_until"))
    return mutations.enqueue(items, o.where(k % 6 == 0).select(F.concat(F.lit("u"), k + 3).alias("url")), o.select("url"), NOW)


@query("interactive_enqueue", f"SELECT coalesce(url, asked) AS url, o_orderkey AS item_id, CASE WHEN asked IS NOT NULL OR o_orderpriority = '1-URGENT' THEN 255 ELSE 0 END AS priority, CASE WHEN asked IS NULL THEN o_orderkey END AS crawled_time, CASE WHEN asked IS NULL THEN o_orderkey END AS claimed_until {_ENQUEUE}")
def interactive_enqueue(spark, d):
    return _enqueued(spark, d)[0]


@query("enqueue_forgets", f"SELECT url {_ENQUEUE} WHERE asked IS NULL")
def enqueue_forgets(spark, d):
    return _enqueued(spark, d)[2]


_DEAD = "SELECT 'u' || (o_custkey % 700) AS url, arg_max(o_orderpriority, o_orderkey) AS reason, max(o_orderkey) AS dead_time FROM orders GROUP BY 1"


@query("dead_upsert", _DEAD)
def dead_upsert(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("u"), (F.col("o_custkey") % 700)).alias("url"), F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("dead_time"))
    return mutations.dead_upsert(rows.where("dead_time % 2 = 0"), rows.where("dead_time % 2 = 1"))


@query("dead_ttl", "SELECT o_orderkey AS id FROM orders WHERE 820454400 - CAST(epoch(o_orderdate) AS BIGINT) < 7776000")
def dead_ttl(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("dead_time"))
    return mutations.dead_alive(rows, NOW).select("id")


@query("setting_upsert", "SELECT event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def setting_upsert(spark, d):
    return mutations.latest(table(spark, d, "events").select(F.col("event_type").alias("name"), "value", "event_id"), "name", "value", "event_id")


@query("domain_revision", "SELECT count(*) AS bumps FROM supplier WHERE s_suppkey % 3 = 0")
def domain_revision(spark, d):
    hosts = view(spark, d, "hosts").select("host_id", "domain")
    return mutations.domain_revisions(hosts, hosts.withColumn("domain", F.when(F.col("host_id") % 3 == 0, F.concat("domain", F.lit("x"))).otherwise(F.col("domain"))))


@query("retrieval_state", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'available' WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'reading' ELSE 'queued' END AS state FROM orders")
def retrieval_state(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("id"), F.when(k % 11 == 0, "x").alias("failure"), F.when(F.col("o_orderstatus") == "F", 1).alias("crawled_time"), F.when(k % 5 == 0, NOW).otherwise(NOW + 60).alias("deadline"), F.when(k % 3 == 0, NOW + 100).alias("claimed_until"))
    return rows.select("id", predicates.retrieval_state(F.lit(NOW)).alias("state"))


# text

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


_CAPPED = f"""WITH w AS (SELECT doc_id, l.i AS line, p.i AS place, split(split(text, chr(10))[l.i], ' ')[p.i] AS word FROM documents, LATERAL (SELECT unnest(range(1, len(split(text, chr(10))) + 1)) AS i) l, LATERAL (SELECT unnest(range(1, len(split(split(text, chr(10))[l.i], ' ')) + 1)) AS i) p),
  s AS (SELECT doc_id, line, place, regexp_split_to_array(lower(word), '[^\\p{{L}}\\p{{N}}]+') AS ts FROM w),
  t AS (SELECT doc_id, line, place, j.i AS sub, ts[j.i] AS term FROM s, LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i) j WHERE len(ts[j.i]) >= 3 AND ts[j.i] NOT IN ({_STOP})),
  n AS (SELECT doc_id, line, place, row_number() OVER (PARTITION BY doc_id, term ORDER BY line, place, sub) AS nth FROM t),
  o AS (SELECT DISTINCT doc_id, line, place FROM n WHERE nth > 50),
  k AS (SELECT w.* FROM w ANTI JOIN o USING (doc_id, line, place)),
  l AS (SELECT w.doc_id, w.line, coalesce(max(x.content), '') AS content FROM (SELECT DISTINCT doc_id, line FROM w) w LEFT JOIN (SELECT doc_id, line, string_agg(word, ' ' ORDER BY place) AS content FROM k GROUP BY 1, 2) x USING (doc_id, line) GROUP BY 1, 2),
  c AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY line) AS capped FROM l GROUP BY doc_id)"""


@query("term_cap", f"{_CAPPED} SELECT doc_id, md5(capped) AS capped FROM c")
def term_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.capped(F.col("text")).cast("binary")).alias("capped"))


@query("whitespace", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t\x0B\f\r ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11))) AS clean FROM documents")
def whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text")).cast("binary")).alias("clean"))


_CUT = r"regexp_replace(left(text, 120), '[ \t\n\r\x00\x0B]+$', '')"


@query("truncate", f"WITH c AS (SELECT doc_id, text, {_CUT} AS cut FROM documents), p AS (SELECT *, CASE WHEN strpos(cut, ' ') > 0 THEN length(cut) - strpos(reverse(cut), ' ') ELSE -1 END AS last FROM c) SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN last > 96 THEN regexp_replace(left(cut, CAST(last AS INT)), '[ \\t\\n\\r\\x00\\x0B]+$', '') || '…' ELSE cut || '…' END AS short FROM p")
def truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 120).alias("short"))


@query("snippet", "SELECT doc_id, strpos(lower(text), 'tion') AS at, CASE WHEN strpos(lower(text), 'tion') > 0 THEN substring(text, greatest(1, strpos(lower(text), 'tion') - 150), 400) END AS snippet FROM documents")
def snippet(spark, d):
    at, cut = text.snippet(F.col("text"), "tion")
    return table(spark, d, "documents").select("doc_id", at.alias("at"), cut.alias("snippet"))


_SHOWN = r"""WITH a AS (SELECT doc_id, text, strpos(lower(text), 'tion') AS place FROM documents), s AS (SELECT doc_id, place, CASE WHEN place > 0 THEN substring(text, greatest(1, place - 150), 400) END AS cut, text FROM a),
  r AS (SELECT *, CASE WHEN cut IS NULL THEN text WHEN place > 151 AND strpos(cut, ' ') BETWEEN 1 AND 30 THEN substring(cut, strpos(cut, ' ') + 1) ELSE cut END AS rest, CASE WHEN cut IS NULL THEN 500 ELSE 380 END AS n FROM s),
  t AS (SELECT *, regexp_replace(left(rest, n), '[ \t\n\r\x00\x0B]+$', '') AS c FROM r),
  p AS (SELECT *, CASE WHEN strpos(c, ' ') > 0 THEN length(c) - strpos(reverse(c), ' ') ELSE -1 END AS last FROM t)
  SELECT doc_id, CASE WHEN cut IS NOT NULL AND place > 151 THEN '…' ELSE '' END || CASE WHEN length(rest) <= n THEN rest WHEN last > CAST(n * 0.8 AS INT) THEN regexp_replace(left(c, CAST(last AS INT)), '[ \t\n\r\x00\x0B]+$', '') || '…' ELSE c || '…' END AS shown FROM p"""


@query("display_text", _SHOWN)
def display_text(spark, d):
    at, cut = text.snippet(F.col("text"), "tion")
    return table(spark, d, "documents").select("doc_id", text.display_text(F.col("text"), cut, at).alias("shown"))


@query("highlight", "SELECT p_partkey, regexp_replace(p_name, '(red|widget)', '<mark>\\1</mark>', 'gi') AS marked FROM part")
def highlight(spark, d):
    return table(spark, d, "part").select("p_partkey", text.highlight(F.col("p_name"), "red widget of").alias("marked"))


@query("content_hash", f"{_CAPPED} SELECT d.doc_id, sha1(coalesce(c.capped, '')) AS hash FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id")
def content_hash(spark, d):
    """The hash of the text as it is stored: capped."""
    return table(spark, d, "documents").select("doc_id", text.content_hash(text.capped(F.col("text"))).alias("hash"))


@query("content_type", "SELECT p_partkey, lower(trim(split_part(h, ';', 1))) AS kind, nullif(regexp_extract(h, 'charset\\s*=\\s*\"?([^\";]+)\"?', 1, 'i'), '') AS charset FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' Text/HTML ; Charset=\"utf-8\"' WHEN p_partkey % 3 = 1 THEN 'image/' || p_type ELSE 'text/plain;charset=ISO-8859-1' END AS h FROM part)")
def content_type(spark, d):
    k = F.col("p_partkey") % 3
    header = F.when(k == 0, ' Text/HTML ; Charset="utf-8"').when(k == 1, F.concat(F.lit("image/"), "p_type")).otherwise("text/plain;charset=ISO-8859-1")
    kind, charset = text.content_type(header)
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), charset.alias("charset"))


@query("robots_tokens", "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS noindex, p_partkey % 5 = 0 AS nofollow FROM part")
def robots_tokens(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 5 == 0, " NONE , max-snippet:3").when(k % 3 == 0, "NoIndex,follow").otherwise("all")
    return table(spark, d, "part").select("p_partkey", text.robots_tokens(value).alias("r")).select("p_partkey", "r.noindex", "r.nofollow")


@query("byte_size", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey WHEN p_partkey % 4 = 1 THEN p_partkey * 1500000000 WHEN p_partkey % 4 = 2 THEN p_partkey * 1000000000000 END AS BIGINT) AS bytes FROM part")
def byte_size(spark, d):
    k = F.col("p_partkey")
    spelt = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat((k * F.lit(1.5).cast("decimal(3,1)")).cast("string"), F.lit("G"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("tb"))).otherwise("12Q")
    return table(spark, d, "part").select("p_partkey", text.byte_size(spelt).alias("bytes"))
