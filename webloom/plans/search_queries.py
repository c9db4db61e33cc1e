"""Search, link-graph and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import catalogue, mutations, predicates, search
from webloom.plans.registry import query
from webloom.plans.views import view, with_views
from webloom.session import Scratch
from webloom.streaming import jobs

_FIELDS = (("title", 10), ("description", 3), ("full_text", 1))
_SEARCHABLE = """idx AS (SELECT * FROM items WHERE crawled_time IS NOT NULL AND noindex = 0
  AND (lower(type) IN ('text/html', 'application/xhtml+xml', 'application/pdf', 'text/plain') OR lower(type) LIKE 'image/%')
  AND (coalesce(title, '') <> '' OR coalesce(description, '') <> '' OR coalesce(full_text, '') <> ''))"""


def _tf(toks: str, words: tuple[str, ...]) -> str:
    cond = " AND ".join(f"{toks}[i + {j}] = '{w}'" for j, w in enumerate(words))
    return f"len(list_filter(range(1, len({toks}) + 1), lambda i: {cond}))"


def _toks(col: str) -> str:
    return f"regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _scored(q: str) -> str:
    """CTEs that score idx: rel(item_id, relevance)."""
    parts = [f"SELECT item_id, {g} AS g, '{f}' AS field, {w} AS w, len({_toks(f)}) AS dl, {_tf(_toks(f), words)} AS tf FROM idx" for g, words in enumerate(search.groups(q)) for f, w in _FIELDS]
    means = " ".join(f"WHEN '{f}' THEN (SELECT avg(len({_toks(f)})) FROM idx)" for f, _ in _FIELDS)
    return f"""tf0 AS ({' UNION ALL '.join(parts)}), tf AS (SELECT * FROM tf0 WHERE tf > 0),
    df AS (SELECT g, field, count(*) AS df FROM tf GROUP BY g, field),
    rel AS (SELECT item_id, CAST(sum(CAST(round(ln(1.0 + ((SELECT count(*) FROM idx) - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / CASE tf.field {means} END)) * w * 1e6) AS BIGINT)) AS BIGINT) AS relevance
      FROM tf JOIN df USING (g, field) GROUP BY item_id)"""


_PAGES = "WHERE lower(i.type) NOT LIKE 'image/%'"


def _pool(q: str, facet: str = _PAGES) -> str:
    return f"pool AS (SELECT i.item_id, i.inc, r.relevance FROM idx i JOIN rel r USING (item_id) {facet} ORDER BY relevance DESC, inc DESC, item_id LIMIT 2000)"


def _lm(q: str, only_pool: bool = True) -> str:
    cond = " OR ".join(f"{_tf(_toks('description'), words)} > 0" for words in search.groups(q))
    inside = "AND child_id IN (SELECT item_id FROM pool)" if only_pool else ""
    return f"lm AS (SELECT child_id AS item_id, count(DISTINCT domain) AS link_matches FROM edges WHERE external = 1 {inside} AND ({cond}) GROUP BY child_id)"


def _page_sql(q: str, facet: str = _PAGES, offset: int = 0) -> str:
    word = search.first_search_word(q).lower()
    at = f"strpos(lower(coalesce(i.full_text, '')), '{word}')"
    return with_views(
        f""", {_SEARCHABLE}, {_scored(q)}, {_pool(q, facet)}, {_lm(q)},
      ranked AS (SELECT p.*, coalesce(lm.link_matches, 0) AS link_matches, row_number() OVER (ORDER BY coalesce(lm.link_matches, 0) DESC, relevance DESC, inc DESC, p.item_id) AS position FROM pool p LEFT JOIN lm USING (item_id))
      SELECT CAST(r.position AS INTEGER) AS position, r.item_id, r.link_matches, r.relevance, r.inc, i.url, i.title, i.description,
        CASE WHEN {at} > 0 THEN substring(i.full_text, greatest(1, {at} - 150), 400) END AS snippet
      FROM ranked r JOIN idx i USING (item_id) WHERE r.position > {offset} AND r.position <= {offset + 51}""",
        "items", "edges",
    )


_BUILT: dict = {}


def _index(spark, d, kind):
    """The written index of a table folder, built on the first use in a session."""
    at = (spark.sparkContext.applicationId, d, kind)
    if at not in _BUILT:
        scratch = Scratch(spark, "index")
        if kind == "items":
            index = search.item_index(scratch)
            index.rebuild(search.indexable(view(spark, d, "items").where(predicates.searchable())))
        else:
            index = search.link_index(scratch)
            index.rebuild(view(spark, d, "edges"))
        _BUILT[at] = index
    return _BUILT[at]


def _search(q: str, images: bool = False, offset: int = 0):
    return lambda spark, d: search.search(view(spark, d, "items").where(predicates.searchable()), _index(spark, d, "items"), _index(spark, d, "links"), q, images, offset)


@query("search_index", with_views(f""", {_SEARCHABLE}, f AS ({' UNION ALL '.join(f"SELECT item_id, '{f}' AS field, unnest({_toks(f)}) AS term FROM idx" for f, _ in _FIELDS)})
  SELECT field, term, count(DISTINCT item_id) AS items, count(*) AS occurrences FROM f GROUP BY field, term""", "items"))
def search_index(spark, d):
    """What the index holds: items and occurrences of every term of a field."""
    index = _index(spark, d, "items")
    return index.held().groupBy("field", "term").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("positions")).alias("occurrences"))


def _synced(spark, d):
    """Indexes that start stale and are brought up to date by a stream of queued requests."""
    at = (spark.sparkContext.applicationId, d, "synced")
    if at not in _BUILT:
        scratch = Scratch(spark, "sync")
        items = scratch.save(view(spark, d, "items"), "store-items")
        edges = scratch.save(view(spark, d, "edges"), "store-edges")
        own, links = search.item_index(scratch), search.link_index(scratch)
        stale = items.where(predicates.searchable() & (F.col("item_id") % 4 != 0)).unionByName(items.where("item_id % 9 = 0").withColumn("item_id", -F.col("item_id")))
        own.rebuild(search.indexable(stale.withColumn("inc", F.lit(0).cast("long"))))
        links.rebuild(edges.where("child_id % 2 = 0").withColumn("external", 1 - F.col("external")))
        sync = jobs.IndexSync(own, links, lambda: items.where(predicates.searchable()), lambda: edges)
        ids = items.select("item_id").unionByName(edges.select(F.col("parent_id").alias("item_id"))).unionByName(own.live().select("item_id")).distinct()
        asked = ids.select("item_id", F.when(F.col("item_id") % 3 == 0, 1).otherwise(2).alias("sync_item"), F.when(F.col("item_id") % 5 == 0, 1).otherwise(2).alias("sync_links"))
        asked.repartitionByRange(3, "item_id").write.mode("overwrite").parquet(scratch.path("queue"))
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(scratch.path("queue"))
        sync.run(stream, scratch.path("state")).awaitTermination()
        _BUILT[at] = (own, links)
    return _BUILT[at]


@query("index_sync_items", with_views(f""", {_SEARCHABLE}, f AS ({' UNION ALL '.join(f"SELECT item_id, unnest({_toks(f)}) AS term FROM idx" for f, _ in _FIELDS)})
  SELECT i.item_id, i.inc, lower(i.type) LIKE 'image/%' AS image, count(f.term) AS occurrences FROM idx i LEFT JOIN f USING (item_id) GROUP BY ALL""", "items"))
def index_sync_items(spark, d):
    """After full, count-only, repaired and delete requests the index equals a rebuild of the store."""
    index = _synced(spark, d)[0]
    held = index._postings().groupBy("item_id", "gen").agg(F.sum(F.size("positions")).alias("n"))
    return index.live().join(held, ["item_id", "gen"], "left").select("item_id", "inc", "image", F.coalesce("n", F.lit(0)).alias("occurrences"))


@query("index_sync_links", with_views("SELECT parent_id, child_id, domain, external FROM edges", "edges"))
def index_sync_links(spark, d):
    return _synced(spark, d)[1].live().select("parent_id", "child_id", "domain", "external")


_QUEUE_NOW = "q AS (SELECT l_partkey AS item_id, count(*) AS generation FROM lineitem GROUP BY 1), s AS (SELECT l_partkey AS item_id, count(*) AS generation FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1)"


@query("queue_settle", f"WITH {_QUEUE_NOW} SELECT q.item_id, q.generation FROM q LEFT JOIN s USING (item_id) WHERE s.generation IS NULL OR s.generation <> q.generation")
def queue_settle(spark, d):
    """Requests that came while a drained batch was worked on stay in the queue."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("item_id"), "l_linenumber")
    count = lambda rows: rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("generation"))
    return mutations.settle_queue(count(line), count(line.where("l_linenumber <= 4")))


_Q = "red widget"
query("search_page", _page_sql(_Q))(_search(_Q))
query("search_offset", _page_sql(_Q, offset=50))(_search(_Q, offset=50))
query("search_images", _page_sql(_Q, "WHERE lower(i.type) LIKE 'image/%'"))(_search(_Q, images=True))
query("search_phrase", _page_sql('"red widget"'))(_search('"red widget"'))
query("search_mixed", _page_sql('"small gear" blue'))(_search('"small gear" blue'))


@query("content_pool", with_views(f", {_SEARCHABLE}, {_scored(_Q)}, {_pool(_Q)} SELECT * FROM pool", "items"))
def content_pool(spark, d):
    return search.content_pool(_index(spark, d, "items"), _Q)


@query("external_link_matches", with_views(f", {_lm(_Q, False)} SELECT * FROM lm", "edges"))
def external_link_matches(spark, d):
    return search.external_link_matches(_index(spark, d, "links"), _Q)


_FOCUSED = f""", tf AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT parent_id, child_id, {g} AS g, len({_toks('description')}) AS dl, {_tf(_toks('description'), w)} AS tf FROM edges" for g, w in enumerate(search.groups(_Q)))}) WHERE tf > 0),
  df AS (SELECT g, count(*) AS df FROM tf GROUP BY g), st AS (SELECT count(*) AS n, avg(len({_toks('description')})) AS m FROM edges),
  per AS (SELECT parent_id, child_id, sum(CAST(round(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / m)) * 1e6) AS BIGINT)) AS w FROM tf JOIN df USING (g), st GROUP BY ALL),
  foc AS (SELECT child_id, CAST(max(w) AS BIGINT) AS score FROM per GROUP BY child_id ORDER BY score DESC, child_id LIMIT 1000)"""


@query("focused_candidates", with_views(f"{_FOCUSED} SELECT * FROM foc", "edges"))
def focused_candidates(spark, d):
    return search.focused_candidates(_index(spark, d, "links"), _Q, 1000)


@query("focused_pick", with_views(f"{_FOCUSED} SELECT f.child_id AS item_id, f.score FROM foc f JOIN items i ON f.child_id = i.item_id WHERE i.crawled_time IS NULL ORDER BY f.score DESC, f.child_id LIMIT 10", "edges", "items"))
def focused_pick(spark, d):
    return catalogue.focused_pick(search.focused_candidates(_index(spark, d, "links"), _Q, 1000), view(spark, d, "items"), 10)


@query("edge_enrichment", with_views("SELECT parent_id * 4294967296 + child_id AS id, parent_id, child_id, domain, external, description FROM edges", "edges"))
def edge_enrichment(spark, d):
    parents = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("item_id"), F.col("c_nationkey").cast("string").alias("domain"))
    return catalogue.edge_enrichment(view(spark, d, "links"), parents, view(spark, d, "item_host"), view(spark, d, "hosts"))


@query("searchable_items", with_views(f", {_SEARCHABLE} SELECT item_id, type, CASE WHEN lower(type) LIKE 'image/%' THEN 1 ELSE 0 END AS is_image FROM idx", "items"))
def searchable_items(spark, d):
    return view(spark, d, "items").where(predicates.searchable()).select("item_id", "type", predicates.is_image(F.col("type")).cast("int").alias("is_image"))


@query("item_by_id", with_views("SELECT item_id, url, title FROM items WHERE item_id = 7 OR url = 'https://example.com/p/9'", "items"))
def item_by_id(spark, d):
    items = view(spark, d, "items")
    return items.where((F.col("item_id") == 7) | (F.lower("url") == "https://example.com/p/9")).select("item_id", "url", "title")


@query("items_by_keys", with_views("SELECT item_id, url FROM items WHERE item_id IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.05)", "items"))
def items_by_keys(spark, d):
    keys = spark.read.parquet(f"{d}/lineitem.parquet").where("l_discount > 0.05").select(F.col("l_partkey").alias("item_id"))
    return view(spark, d, "items").select("item_id", "url").join(keys, "item_id", "left_semi")


_REFERRER = "SELECT k.child_id AS item_id, min(k.parent_id) AS parent_id FROM links k JOIN customer c ON k.parent_id = c.c_custkey WHERE c.c_acctbal >= 0 GROUP BY k.child_id"


@query("referrer", with_views(_REFERRER, "links"))
def referrer(spark, d):
    known = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal >= 0").select(F.col("c_custkey").alias("item_id"))
    return catalogue.referrer(view(spark, d, "links"), known)


@query("item_preview", with_views(f", r AS ({_REFERRER}) SELECT i.item_id, i.title, i.description, i.crawled_time, r.parent_id FROM items i LEFT JOIN r USING (item_id) WHERE i.crawled_time IS NOT NULL AND i.noindex = 0", "items", "links"))
def item_preview(spark, d):
    known = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal >= 0").select(F.col("c_custkey").alias("item_id"))
    return catalogue.item_preview(view(spark, d, "items"), catalogue.referrer(view(spark, d, "links"), known))


@query("inbound_counts", with_views("SELECT i.item_id, coalesce(b.inc, 0) AS inc FROM items i LEFT JOIN inbound b USING (item_id)", "items", "inbound"))
def inbound_counts(spark, d):
    return catalogue.inbound_counts(view(spark, d, "items").select("item_id"), view(spark, d, "links"))


@query("stale_link_revisions", "SELECT p_partkey AS item_id FROM part LEFT JOIN (SELECT p_partkey AS k, p_partkey % 3 AS rev FROM part WHERE p_partkey % 4 <> 0) r ON p_partkey = k WHERE rev IS NULL OR rev <> 2")
def stale_link_revisions(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    done = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 3).alias("revision"))
    return catalogue.stale_revisions(part.select(F.col("p_partkey").alias("item_id")), done, 2)


_LIVE = "requests AS (SELECT o_orderkey AS request_id, o_orderkey % 500 AS item_id, 820454400 + (o_orderkey * 53) % 240 - 120 AS deadline, CASE WHEN o_orderkey % 9 = 0 THEN 'timeout' END AS failure FROM orders)"


def _requests(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 500).alias("item_id"), (F.lit(820454400) + (F.col("o_orderkey") * 53) % 240 - 120).alias("deadline"), F.when(F.col("o_orderkey") % 9 == 0, "timeout").alias("failure"))


@query("live_priority_items", f"WITH {_LIVE} SELECT p_partkey AS item_id FROM part WHERE EXISTS (SELECT 1 FROM requests r WHERE r.item_id = p_partkey AND r.failure IS NULL AND r.deadline > 820454400)")
def live_priority_items(spark, d):
    items = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_id"))
    return catalogue.live_items(items, _requests(spark, d), 820454400)


@query("dead_requests", f"WITH {_LIVE} SELECT r.request_id, r.item_id, 'expired' AS failure, CASE WHEN NOT EXISTS (SELECT 1 FROM requests q WHERE q.item_id = r.item_id AND q.failure IS NULL AND q.deadline > 820454400) THEN 1 ELSE 0 END AS drop_priority FROM requests r WHERE r.failure IS NULL AND r.deadline <= 820454400")
def dead_requests(spark, d):
    return catalogue.expire_requests(_requests(spark, d), 820454400)


@query("alias_resolution", "WITH req AS (SELECT o_orderkey % 3000 AS item_id FROM orders GROUP BY 1), alias AS (SELECT p_partkey + 1000 AS source, min(p_partkey) AS target FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT r.item_id, coalesce(d.p_partkey, a.target) AS resolved FROM req r LEFT JOIN part d ON d.p_partkey = r.item_id AND d.p_partkey % 5 <> 0 LEFT JOIN alias a ON a.source = r.item_id")
def alias_resolution(spark, d):
    part, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "orders"))
    asked = orders.select((F.col("o_orderkey") % 3000).alias("item_id")).distinct()
    aliases = part.where("p_partkey % 2 = 0").select((F.col("p_partkey") + 1000).alias("source_id"), F.col("p_partkey").alias("target_id"))
    return catalogue.resolve_aliases(asked, part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("item_id")), aliases)


@query("new_edges", with_views("SELECT parent_id, child_id FROM links WHERE NOT (parent_id % 3 = 0 AND child_id % 2 = 0) AND parent_id <> child_id", "links"))
def new_edges(spark, d):
    links = view(spark, d, "links")
    return catalogue.new_edges(links.select("parent_id", "child_id"), links.where("parent_id % 3 = 0 and child_id % 2 = 0"))


@query("missing_docs", with_views("SELECT item_id, CASE WHEN item_id % 13 = 0 THEN 'delete' ELSE 'full' END AS action FROM items WHERE item_id % 13 = 0 OR (inc % 5 = 0 AND item_id % 13 <> 0)", "items"))
def missing_docs(spark, d):
    items = view(spark, d, "items")
    index = items.select("item_id", F.when(F.col("inc") % 5 == 0, F.lit(None).cast("long")).otherwise(F.col("inc")).alias("inc"))
    return catalogue.presence_diff(index, items.where("item_id % 13 <> 0").select("item_id", "inc"))


@query("union_ids", "SELECT DISTINCT id FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT -p_partkey FROM part UNION ALL SELECT p_partkey FROM part) WHERE id > 0")
def union_ids(spark, d):
    line, part = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "part"))
    return catalogue.union_ids(line.select(F.col("l_partkey").alias("id")), part.select((-F.col("p_partkey")).alias("id")), part.select(F.col("p_partkey").alias("id")))


_TOTALS = """SELECT count(*) AS found, count(crawled_time) AS indexed, count(*) FILTER (WHERE item_id IN (SELECT item_id FROM idx)) AS searchable, count(*) FILTER (WHERE crawled_time IS NULL) AS queued,
  count(*) FILTER (WHERE crawled_time IS NOT NULL AND lower(type) NOT LIKE 'image/%') AS pages, count(*) FILTER (WHERE crawled_time IS NOT NULL AND lower(type) LIKE 'image/%') AS images, (SELECT count(*) FROM hosts) AS hosts, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS dead FROM items"""


@query("catalogue_totals", with_views(f", {_SEARCHABLE} {_TOTALS}", "items", "hosts"))
def catalogue_totals(spark, d):
    return catalogue.totals(view(spark, d, "items"), view(spark, d, "hosts"), spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'"))


@query("counter_deltas", with_views(f", {_SEARCHABLE} {_TOTALS}".replace(", (SELECT count(*) FROM hosts) AS hosts, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS dead", ""), "items"))
def counter_deltas(spark, d):
    """Totals after a log of changes (every item arrives uncrawled, then takes its state) equal the recount."""
    items = view(spark, d, "items")
    blank = items.withColumn("crawled_time", F.lit(None).cast("long"))
    log = blank.withColumn("sign", F.lit(1)).unionByName(blank.withColumn("sign", F.lit(-1))).unionByName(items.withColumn("sign", F.lit(1)))
    return catalogue.counter_deltas(log)


@query("pending_per_host", with_views("SELECT host_id, count(*) AS pending FROM frontier WHERE crawled_time IS NULL GROUP BY host_id", "frontier"))
def pending_per_host(spark, d):
    return catalogue.pending_per_host(view(spark, d, "frontier"))


@query("crawled_last_hour", "SELECT count(*) AS crawled FROM events WHERE ts >= TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'")
def crawled_last_hour(spark, d):
    """Both ends belong to the hour, to the microsecond."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.where("cast(ts as timestamp_ntz) between timestamp_ntz '2024-01-15 11:00:00' and timestamp_ntz '2024-01-15 12:00:00'").agg(F.count(F.lit(1)).alias("crawled"))


@query("count_groups", with_views("SELECT inc, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM items GROUP BY inc", "items"))
def count_groups(spark, d):
    return view(spark, d, "items").groupBy("inc").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))


@query("thumbnail_shard", "SELECT p_partkey AS item_id, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '/' || lpad(CAST(p_partkey // 100 % 100 AS VARCHAR), 2, '0') || '/' || lpad(CAST(p_partkey // 10000 % 100 AS VARCHAR), 2, '0') AS path FROM part")
def thumbnail_shard(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_id"), predicates.thumbnail_shard(F.col("p_partkey")).alias("path"))


@query("keyset_page", with_views("SELECT item_id, crawled_time FROM items WHERE crawled_time IS NOT NULL AND (crawled_time > 1700006000 OR (crawled_time = 1700006000 AND item_id > 100)) ORDER BY crawled_time, item_id LIMIT 500", "items"))
def keyset_page(spark, d):
    return catalogue.keyset_page(view(spark, d, "items").where("crawled_time is not null").select("item_id", "crawled_time"), ("crawled_time", "item_id"), (1700006000, 100), 500)


@query("feed_seed", with_views("SELECT item_id, crawled_time FROM (SELECT item_id, crawled_time FROM items WHERE crawled_time IS NOT NULL ORDER BY crawled_time DESC, item_id DESC LIMIT 50) ORDER BY crawled_time, item_id", "items"))
def feed_seed(spark, d):
    return catalogue.feed(view(spark, d, "items"), None).select("item_id", "crawled_time")


@query("feed_forward", with_views("SELECT item_id, crawled_time FROM items WHERE crawled_time >= 1700030000 ORDER BY crawled_time, item_id LIMIT 50", "items"))
def feed_forward(spark, d):
    return catalogue.feed(view(spark, d, "items"), 1700030000).select("item_id", "crawled_time")
