"""Queries of the small decisions, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import html, net, text
from webloom.operators import policy, search
from webloom.plans.registry import query
from webloom.plans.search_queries import _FOCUSED, _index
from webloom.plans.views import NOW, view, with_views
from webloom.session import spread, table
from webloom.streaming import jobs

def _k():
    return F.col("o_orderkey")


@query("recently_failed", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN FALSE ELSE o_orderkey % 600 < 300 END AS recent FROM orders")
def recently_failed(spark, d):
    failed = F.when(_k() % 4 != 0, F.lit(NOW) - _k() % 600)
    return table(spark, d, "orders").select("o_orderkey", policy.recently_failed(failed, F.lit(NOW)).alias("recent"))


@query("crawl_window", f"SELECT o_orderkey, NOT (o_orderkey % 5 = 0) AND (NOT (o_orderkey % 2 = 0) OR (CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE {NOW} + o_orderkey % 200 - 100 END) > {NOW}) AS allowed, {NOW} + least(o_orderkey % 200, 60) AS lease FROM orders")
def crawl_window(spark, d):
    until = F.when(_k() % 7 != 0, (F.lit(NOW) + _k() % 200 - 100).cast("string"))
    mode = F.when(_k() % 5 == 0, "1").when(_k() % 3 == 0, "0")
    allowed = policy.crawl_allowed(mode, _k() % 2 == 0, until, F.lit(NOW))
    return table(spark, d, "orders").select("o_orderkey", allowed.alias("allowed"), policy.lease_until(F.lit(NOW) + _k() % 200, F.lit(NOW)).alias("lease"))


@query("blocked_host", "SELECT p_partkey, p_partkey % 4 < 2 AS blocked FROM part")
def blocked_host(spark, d):
    k = F.col("p_partkey")
    host = F.concat(F.when(k % 4 == 0, "ads.").when(k % 4 == 1, "a.b.ADS.").when(k % 4 == 2, "evilads.").otherwise("ads.example."), F.when(k % 4 == 3, "org").otherwise("example.com"))
    return table(spark, d, "part").select("p_partkey", policy.below_host(host, F.array(F.lit("ads.example.com"), F.lit("track.net"))).alias("blocked"))


@query("disk_reserve", "SELECT p_partkey, p_partkey % 10 BETWEEN 1 AND 9 AND p_size * 100 >= 1000 AND p_size * 100 <= 4000 AND 1 - p_size * 100 / 4000.0 < 0.95 AS allowed FROM part")
def disk_reserve(spark, d):
    free = F.when(F.col("p_partkey") % 10 == 0, -1).otherwise(F.col("p_size") * 100).cast("double")
    return table(spark, d, "part").select("p_partkey", policy.write_allowed(free, F.lit(4000.0), 1000).alias("allowed"))


@query("usable_image", "SELECT p_partkey, p_size * 10 >= 100 AND p_partkey * 50 >= 100 AND CAST(p_size AS BIGINT) * 10 * p_partkey * 50 <= 40000000 AS usable FROM part")
def usable_image(spark, d):
    return table(spark, d, "part").select("p_partkey", policy.usable_image(F.col("p_size") * 10, F.col("p_partkey") * 50).alias("usable"))


@query("crawler_running", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN FALSE ELSE o_orderkey % 90 <= 45 END AS running FROM orders")
def crawler_running(spark, d):
    return table(spark, d, "orders").select("o_orderkey", policy.crawler_running(F.when(_k() % 6 != 0, F.lit(NOW) - _k() % 90), F.lit(NOW)).alias("running"))


@query("challenge_page", "SELECT p_partkey, p_partkey % 3 = 0 AS challenge FROM part")
def challenge_page(spark, d):
    k = F.col("p_partkey")
    markup = F.concat(F.lit("<title>"), F.when(k % 3 == 0, "Just a moment...").when(k % 3 == 1, "Just a moment... more").otherwise(""), F.lit("</title><p>Just a moment...</p>"))
    return spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", html.read_page(F.lit("https://h.com/"), markup, wanted=("title",)).alias("p")).select("p_partkey", policy.is_challenge(F.col("p.title")).alias("challenge"))


@query("earliest_request", "SELECT o_orderkey AS request_id, o_custkey AS item_id, o_orderkey * 31 % 997 AS deadline FROM orders WHERE o_orderkey % 9 <> 0 ORDER BY deadline, request_id LIMIT 1")
def earliest_request(spark, d):
    rows = table(spark, d, "orders").select(_k().alias("request_id"), F.col("o_custkey").alias("item_id"), (_k() * 31 % 997).alias("deadline"), F.when(_k() % 9 == 0, "x").alias("failure"))
    return policy.earliest_request(rows)


@query("egress_rotation", "SELECT o_orderkey AS id, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INT) AS address FROM orders")
def egress_rotation(spark, d):
    return policy.egress(table(spark, d, "orders").select(_k().alias("id")), 7)


@query("search_throttle", "WITH s AS (SELECT event_type AS engine, event_id AS id, epoch_us(ts) AS b, epoch_us(ts) + event_id % 5 * 1000000 AS e FROM events), g AS (SELECT *, b - lag(e) OVER (PARTITION BY engine ORDER BY b, id) AS gap FROM s) SELECT engine, id, gap FROM g WHERE gap < 2000000")
def search_throttle(spark, d):
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select(F.col("event_type").alias("engine"), F.col("event_id").alias("id"), begin.alias("start"), (begin + F.col("event_id") % 5 * 1000000).alias("end"))
    return policy.throttle_gaps(rows, 2000000)


@query("children_page", with_views("SELECT parent_id, child_id FROM links WHERE parent_id = 1 AND child_id > 5 ORDER BY child_id LIMIT 200", "links"))
def children_page(spark, d):
    return policy.neighbours(view(spark, d, "links"), 1, True, 5)


@query("parents_page", with_views("SELECT child_id, parent_id FROM links WHERE child_id = 1 ORDER BY parent_id LIMIT 200", "links"))
def parents_page(spark, d):
    return policy.neighbours(view(spark, d, "links"), 1, False)


@query("item_with_content", with_views("SELECT item_id, url, host_id, title, description, full_text, type, noindex, crawled_time, inc FROM items WHERE item_id = 7", "items"))
def item_with_content(spark, d):
    return view(spark, d, "items").where("item_id = 7")


@query("described", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE left(text, 500) END) AS described FROM documents")
def described(spark, d):
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("d"), "doc_id"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.described(own, F.col("text")).cast("binary")).alias("described"))


@query("retrieval_text", "SELECT doc_id, md5(left(repeat(coalesce(text, ''), 30), 120000)) AS text, strlen(repeat(coalesce(text, ''), 30)) > strlen(left(repeat(coalesce(text, ''), 30), 120000)) AS truncated FROM documents")
def retrieval_text(spark, d):
    cut, truncated = text.retrieval_text(F.repeat(F.coalesce("text", F.lit("")), F.lit(30)))
    return table(spark, d, "documents").select("doc_id", F.md5(cut.cast("binary")).alias("text"), truncated.alias("truncated"))


@query("plain_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'é ' || p_name || chr(10) || 'x' END AS text FROM part")
def plain_text(spark, d):
    k = F.col("p_partkey")
    spelt = F.concat(F.lit(" é  "), "p_name", F.lit(" \r\n x "))
    body = F.when(k % 3 == 0, F.encode(spelt, "ISO-8859-1")).when(k % 3 == 1, spelt.cast("binary")).otherwise(F.lit(" \n ").cast("binary"))
    return table(spark, d, "part").select("p_partkey", text.plain_text(body, F.when(k % 3 == 0, "iso-8859-1").when(k % 3 == 1, "nonsense")).alias("text"))


@query("type_class", with_views("SELECT item_id, CASE WHEN type = 'text/html' THEN 'html' WHEN type LIKE 'image/%' THEN 'image' WHEN type = 'application/pdf' THEN 'pdf' ELSE 'text' END AS class FROM items", "items"))
def type_class(spark, d):
    return view(spark, d, "items").select("item_id", text.type_class(F.col("type")).alias("class"))


@query("totals_shown", "SELECT n_nationkey, format('{:,}', count(*)) AS customers, format('{:,}', CAST(sum(c_custkey) AS BIGINT)) AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def totals_shown(spark, d):
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("k"))
    return rows.select("n_nationkey", F.format_number("n", 0).alias("customers"), F.format_number("k", 0).alias("keys"))


@query("charset_sources", "SELECT p_partkey, 'Ü ' || p_name AS title FROM part")
def charset_sources(spark, d):
    """Bytes of pages by byte order mark, header, meta tag and default."""
    k = F.col("p_partkey")
    plain = F.concat(F.lit("<title>Ü "), "p_name", F.lit("</title>"))
    body = F.when(k % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), plain.cast("binary"))).when(k % 4 == 1, F.encode(plain, "ISO-8859-1")).when(k % 4 == 2, F.encode(F.concat(F.lit("<meta charset='latin1'>"), plain), "ISO-8859-1")).otherwise(plain.cast("binary"))
    decoded = html.decoded(body, F.when(k % 4 == 1, "iso-8859-1").when(k % 4 == 0, "ascii"))
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", html.read_page(F.lit("https://h.com/"), decoded, wanted=("title",))["title"].alias("title"))


@query("reextraction", "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 5 = 0 THEN 'unreadable' WHEN p_partkey % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS status FROM part")
def reextraction(spark, d):
    """Stored (compressed) markup read anew against the stored text."""
    k = F.col("p_partkey")
    stored = net.compress(F.when(k % 5 != 0, F.concat(F.lit("<body><p>"), "p_name", F.lit("</p><nav>menu</nav></body>"))))
    rows = spread(table(spark, d, "part").select("p_partkey", "p_name")).select(k.alias("item_id"), F.when(k % 2 == 0, F.col("p_name")).otherwise("old").alias("full_text"), net.decompress(stored).alias("html"))
    return policy.reextraction(rows.withColumn("new_text", text.capped(html.read_page(F.lit("https://h.com/"), F.col("html"), wanted=("body",))["body"]))).select("item_id", "status")


@query("request_budgets", "WITH r AS (SELECT event_id, user_id AS client, user_id % 5 AS address, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY client, t // 86400 ORDER BY t, event_id) AS client_n, row_number() OVER (PARTITION BY address, t // 86400 ORDER BY t, event_id) AS address_n FROM r) SELECT event_id, client_n, address_n, CASE WHEN client_n > 3 OR address_n > 20 THEN greatest(1, t // 86400 * 86400 + 86400 - t) END AS retry_after FROM n")
def request_budgets(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), (F.col("user_id") % 5).alias("address"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return jobs.request_budgets(rows, 3, 20, 86400)


_POOLS = policy.PoolCache()


@query("focused_pool_cached", with_views(f"{_FOCUSED} SELECT child_id, score FROM foc", "edges"))
def focused_pool_cached(spark, d):
    """The ranked pool of a query, computed once for a version of the link index."""
    index = _index(spark, d, "links")
    version = (spark.sparkContext.applicationId, d, index.version())
    return _POOLS.get(version, "red widget", 1000, lambda: search.focused_candidates(index, "red widget", 1000))
