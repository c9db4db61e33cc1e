"""Page, URL, robots and streaming queries."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import html, net, robots, urls
from webloom.operators import catalogue
from webloom.plans.registry import query
from webloom.plans.views import NOW, view, with_views
from webloom.session import Scratch, spread, table
from webloom.sources import engines, lists
from webloom.streaming import jobs


def _pages(spark, d, *wanted):
    return spread(table(spark, d, "pages")).select("page_id", "url", html.read_page(F.col("url"), F.col("html"), _domains(spark), wanted).alias("p"))


_META = ("title", "description", "keywords", "canonical", "noindex", "nofollow")
query("page_metadata")(lambda spark, d: _pages(spark, d, *_META).select("page_id", *(f"p.{c}" for c in _META)))
query("page_text")(lambda spark, d: _pages(spark, d, "body").select("page_id", "p.body"))
query("page_links")(lambda spark, d: _pages(spark, d, "links").select("page_id", F.explode("p.links").alias("k")).select("page_id", "k.*"))
query("article_text")(lambda spark, d: spread(table(spark, d, "pages")).select("page_id", html.article_text(F.col("html")).alias("article")))
query("page_urls")(lambda spark, d: table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"), urls.valid_url(F.col("url"), _domains(spark)).alias("valid"), urls.resolve_url(F.col("url"), F.lit("../a/b?c=d e")).alias("resolved")))

_LISTED: dict = {}


def _domains(spark) -> frozenset[str]:
    """Top-level domains from a list file, as the address checks use them (some thousand names at most)."""
    at = spark.sparkContext.applicationId
    if at not in _LISTED:
        scratch = Scratch(spark, "lists")
        spark.createDataFrame([("# names",), *((t.upper(),) for t in (*urls.TLDS, "museum", "xn--p1ai"))], "value string").coalesce(1).write.mode("overwrite").text(scratch.path("domains"))
        spark.createDataFrame([("\n".join(["// comment", *urls.SUFFIXES, "// ===BEGIN PRIVATE DOMAINS===", "blogs.example.com"]),)], "value string").coalesce(1).write.mode("overwrite").text(scratch.path("suffixes"))
        _LISTED[at] = (frozenset(r["tld"] for r in lists.tlds(spark, scratch.path("domains")).collect()), scratch.path("suffixes"))
    return _LISTED[at][0]


_URL = "'HTTP://User@Shop' || (l_suppkey % 7) || '.Example.' || CASE l_linenumber WHEN 1 THEN 'com' WHEN 2 THEN 'museum' WHEN 3 THEN 'nosuch' ELSE 'org' END || ':80/a b/' || l_orderkey || '?z=1&utm_source=x&a=' || l_partkey || '#top'"
_SPELT = "'https://shop' || (l_suppkey % 7) || '.example.' || CASE l_linenumber WHEN 1 THEN 'com' WHEN 2 THEN 'museum' WHEN 3 THEN 'nosuch' ELSE 'org' END || '/a%20b/' || l_orderkey || '?a=' || l_partkey || '&z=1'"


def _urls(spark, d):
    n = F.col("l_linenumber")
    end = F.when(n == 1, "com").when(n == 2, "museum").when(n == 3, "nosuch").otherwise("org")
    url = F.concat(F.lit("HTTP://User@Shop"), F.col("l_suppkey") % 7, F.lit(".Example."), end, F.lit(":80/a b/"), "l_orderkey", F.lit("?z=1&utm_source=x&a="), "l_partkey", F.lit("#top"))
    return spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")).select("l_orderkey", "l_linenumber", url.alias("u"))


@query("canonical_url", f"SELECT l_orderkey, l_linenumber, {_SPELT} AS url FROM lineitem")
def canonical_url(spark, d):
    """Scheme, user, port, spaces, tracking parameters, order of parameters and fragment."""
    return _urls(spark, d).select("l_orderkey", "l_linenumber", urls.canonical_url(F.col("u")).alias("url"))


@query("valid_url", "SELECT l_orderkey, l_linenumber, l_linenumber <> 3 AS valid FROM lineitem")
def valid_url(spark, d):
    return _urls(spark, d).select("l_orderkey", "l_linenumber", urls.valid_url(F.col("u"), _domains(spark)).alias("valid"))


@query("resolve_url", "SELECT l_orderkey, l_linenumber, 'https://h.com' || CASE l_linenumber WHEN 1 THEN '/x/' || l_partkey WHEN 2 THEN '/a/b/' || l_partkey || '?q=1' WHEN 3 THEN '/a/b/c?n=' || l_partkey ELSE '/a/' || l_partkey END AS url FROM lineitem")
def resolve_url(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    ref = F.when(n == 1, F.concat(F.lit("/x/./y/../"), k)).when(n == 2, F.concat(k, F.lit("?q=1"))).when(n == 3, F.concat(F.lit("?n="), k)).otherwise(F.concat(F.lit("../"), k))
    return spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")).select("l_orderkey", "l_linenumber", urls.resolve_url(F.lit("http://H.com/a/b/c?old=1"), ref).alias("url"))


def _parts(spark, d):
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"))


def _made(spark, d):
    """Pages whose markup is made from a table, so that SQL can say what is read off them."""
    k, even = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    head = F.concat(F.lit("<html><head><title> "), "p_name", F.lit("</title><meta name='description' content='d "), "p_brand", F.lit("'><meta name=robots content='"), F.when(k % 3 == 0, "noindex").otherwise("all"), F.lit("'><link rel='canonical' href='/c/"), k, F.lit("?b=2&amp;a=1'></head>"))
    links = F.concat(F.lit("<p>one <a href='/self'>me</a> <a href='/l/"), k, F.lit("'>l</a></p><p><a rel='nofollow' href='/no'>n</a><a href='https://other.com/"), k, F.lit("'>o</a></p><a href='https://id.com/?client_id=1&redirect_uri=2&response_type=3'>in</a><a href='/private/"), k, F.lit("'>p</a><a href='/l/"), k, F.lit("'>again</a><img src='/i.png'>"))
    body = F.concat(F.lit("<body><header>top</header><nav>menu</nav>"), links, F.lit("<div class='sidebar'>side</div><div style='display: none /* x */'>gone</div><p>"), "p_type", F.when(even, "<br>next").otherwise(""), F.lit("</p><footer>end</footer></body></html>"))
    return _parts(spark, d).select(k.alias("page_id"), F.lit("https://h.com/self").alias("url"), F.concat(head, body).alias("html"))


@query("made_page_metadata", "SELECT p_partkey AS page_id, trim(p_name) AS title, 'd ' || p_brand AS description, 'https://h.com/c/' || p_partkey || '?a=1&b=2' AS canonical, p_partkey % 3 = 0 AS noindex, FALSE AS nofollow FROM part")
def made_page_metadata(spark, d):
    return _made(spark, d).select("page_id", html.read_page(F.col("url"), F.col("html"), wanted=_META).alias("p")).select("page_id", "p.title", "p.description", "p.canonical", "p.noindex", "p.nofollow")


@query("made_page_text", "SELECT p_partkey AS page_id, 'one me l' || chr(10) || chr(10) || 'no' || chr(10) || 'inpagain' || chr(10) || chr(10) || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'next' ELSE '' END AS body FROM part")
def made_page_text(spark, d):
    return _made(spark, d).select("page_id", html.read_page(F.col("url"), F.col("html"), wanted=("body",)).alias("p")).select("page_id", "p.body")


@query("made_article_text", "SELECT p_partkey AS page_id, 'one me l' || chr(10) || chr(10) || 'no' || chr(10) || 'inpagain' || chr(10) || 'side' || chr(10) || chr(10) || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'next' ELSE '' END AS article FROM part")
def made_article_text(spark, d):
    return _made(spark, d).select("page_id", html.article_text(F.col("html")).alias("article"))


def admitted(pages, rules, states, known):
    """Discoveries of pages (page_id, url, html): images before links, and no self-links, sign-in links or paths that the own host's robots rules forbid; the first mention of a URL on a page wins."""
    p = pages.select("page_id", urls.link_parts(urls.canonical_url(F.col("url")))["host"].alias("own"), urls.canonical_url(F.col("url")).alias("page"), html.read_page(F.col("url"), F.col("html"), known, ("links", "images")).alias("p"))
    p = p.select("page_id", "own", "page", F.expr("concat(transform(p.images, k -> named_struct('kind', 0, 'k', k)), transform(p.links, k -> named_struct('kind', 1, 'k', k)))").alias("all"))
    files = rules.groupBy("host").agg(F.collect_list(F.struct("kind", "pattern", "regex")).alias("rules"))
    files = states.groupBy("host").agg(F.max("known").alias("known")).join(files, "host", "left").withColumnRenamed("host", "own")
    rows = p.join(files, "own", "left").select("page_id", "page", "own", "known", "rules", F.explode("all").alias("x")).select("page_id", "page", "own", "known", "rules", "x.kind", "x.k.*").where(F.col("url") != F.col("page"))
    rows = rows.withColumn("u", urls.link_parts(F.col("url"))).where("not u.oauth")
    banned = ~F.coalesce("known", F.lit(False)) | robots.disallowed_by(F.col("u.path"), F.col("rules"))
    return catalogue.first_per_group(rows.where((F.col("u.host") != F.col("own")) | ~banned), ["page_id", "url"], "kind", "pos").select("page_id", "url", "kind", "description")


def _own_rules(spark, pages, text):
    hosts = pages.select(urls.link_parts(F.col("url"))["host"].alias("host")).distinct()
    return hosts.select("host", F.explode(robots.parse_rules(F.lit(text))).alias("r")).select("host", "r.*"), hosts.withColumn("known", F.lit(True))


@query("link_admission")
def link_admission(spark, d):
    pages = spread(table(spark, d, "pages"))
    return admitted(pages, *_own_rules(spark, pages, "User-agent: *\nDisallow: /private"), _domains(spark))


@query("made_link_admission", """SELECT p_partkey AS page_id, u.url, u.kind, u.description FROM part, LATERAL (VALUES
  ('https://h.com/i.png', 0, NULL), ('https://h.com/l/' || p_partkey, 1, 'one me l'), ('https://other.com/' || p_partkey, 1, 'no')) AS u(url, kind, description)""".replace("NULL", "'one me l' || chr(10) || chr(10) || 'no' || chr(10) || 'inpagain' || chr(10) || 'side' || chr(10) || chr(10) || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'next' ELSE '' END"))
def made_link_admission(spark, d):
    pages = _made(spark, d)
    out = admitted(pages, *_own_rules(spark, pages, "User-agent: *\nDisallow: /private"), urls.BUILT_IN)
    return out.withColumn("description", F.regexp_replace("description", r"^top\n+menu\n+|\n+end$", ""))


_HOSTS = "SELECT 'a.b' || (s_suppkey % 7) || CASE s_suppkey % 5 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' WHEN 2 THEN '.x.ck' WHEN 3 THEN '.city.kawasaki.jp' ELSE '.unknown' END AS host FROM supplier"


@query("registrable_domain", f"SELECT DISTINCT host, CASE WHEN host LIKE '%.co.uk' THEN 'b' || n || '.co.uk' WHEN host LIKE '%.com' THEN 'b' || n || '.com' WHEN host LIKE '%.x.ck' THEN 'b' || n || '.x.ck' WHEN host LIKE '%kawasaki.jp' THEN 'city.kawasaki.jp' ELSE 'b' || n || '.unknown' END AS domain FROM (SELECT host, substring(host, 4, 1) AS n FROM ({_HOSTS}))")
def registrable_domain(spark, d):
    k = F.col("s_suppkey")
    tail = F.when(k % 5 == 0, ".co.uk").when(k % 5 == 1, ".com").when(k % 5 == 2, ".x.ck").when(k % 5 == 3, ".city.kawasaki.jp").otherwise(".unknown")
    hosts = table(spark, d, "supplier").select(F.concat(F.lit("a.b"), k % 7, tail).alias("host"))
    _domains(spark)
    return urls.registrable_domains(hosts, "host", lists.public_suffixes(spark, _LISTED[spark.sparkContext.applicationId][1]))


_ROBOTS = "User-agent: *\nDisallow: /shop/\nAllow: /shop/public/\nDisallow: /*.pdf$\nDisallow: /a*b\nAllow: /exact\nDisallow: /exact\n"


_PATHS = "SELECT s_suppkey AS k, s_name AS host, '/shop/' || CASE WHEN s_suppkey % 2 = 0 THEN 'public/x' WHEN s_suppkey % 3 = 0 THEN 'a.pdf' ELSE 'cart' END AS path, s_suppkey % 2 <> 0 AS dis FROM supplier UNION ALL SELECT s_suppkey, s_name, '/exact', FALSE FROM supplier UNION ALL SELECT s_suppkey, s_name, '/x/axb.pdf', TRUE FROM supplier UNION ALL SELECT s_suppkey, s_name, '/axxb', TRUE FROM supplier"


def _robots_paths(spark, d):
    """Paths, rules and states of hosts: every fifth file is unknown, every seventh host has no state at all."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    shop = F.concat(F.lit("/shop/"), F.when(k % 2 == 0, "public/x").when(k % 3 == 0, "a.pdf").otherwise("cart"))
    paths = s.select(F.col("s_name").alias("host"), F.explode(F.array(shop, F.lit("/exact"), F.lit("/x/axb.pdf"), F.lit("/axxb"))).alias("path"))
    rules = s.select(F.col("s_name").alias("host"), F.explode(robots.parse_rules(F.lit(_ROBOTS))).alias("r")).select("host", "r.*")
    return paths, rules, s.where(k % 7 != 0).select(F.col("s_name").alias("host"), (k % 5 != 0).alias("known"))


@query("robots_decision", f"SELECT host, path, dis OR k % 5 = 0 OR k % 7 = 0 AS disallowed FROM ({_PATHS})")
def robots_decision(spark, d):
    return robots.decide(*_robots_paths(spark, d))


@query("fetch_permission", f"SELECT host, path, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'robots-unknown' WHEN dis THEN 'disallowed' ELSE 'allowed' END AS permission FROM ({_PATHS})")
def fetch_permission(spark, d):
    paths, rules, states = _robots_paths(spark, d)
    return robots.decide(paths, rules, states).join(states, "host", "left").select("host", "path", robots.permission(F.col("known"), F.col("disallowed")).alias("permission"))


@query("robots_fetch", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS state, CASE s_suppkey % 6 WHEN 0 THEN 'Disallow: /' || s_suppkey WHEN 1 THEN '' WHEN 5 THEN 'bom' END AS text FROM supplier")
def robots_fetch(spark, d):
    """State and text of responses: rules, missing, server error, a page instead of rules, no answer, byte order mark."""
    k = F.col("s_suppkey") % 6
    status = F.when(k == 1, 404).when(k == 2, 503).when(k != 4, 200).cast("double")
    kind = F.when(k == 3, "text/html").otherwise("text/plain; charset=utf-8")
    body = F.when(k == 5, F.concat(F.unhex(F.lit("EFBBBF")), F.lit("bom").cast("binary"))).otherwise(F.concat(F.lit("Disallow: /"), "s_suppkey").cast("binary"))
    return table(spark, d, "supplier").select("s_suppkey", robots.fetched_state(status, kind, body).alias("r")).select("s_suppkey", "r.state", "r.text")


@query("robots_stale", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN TRUE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7200 >= 3600 ELSE o_orderkey % 900000 >= 604800 END AS stale FROM orders")
def robots_stale(spark, d):
    k = F.col("o_orderkey")
    fetched = F.when(k % 5 == 0, None).when(k % 3 == 0, F.lit(NOW) - k % 7200).otherwise(F.lit(NOW) - k % 900000)
    return table(spark, d, "orders").select("o_orderkey", robots.stale(F.when(k % 3 == 0, 0).otherwise(1), fetched, F.lit(NOW)).alias("stale"))


@query("robots_delay", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(ceil(s_suppkey / 2) AS INT) END AS delay FROM supplier")
def robots_delay(spark, d):
    k = F.col("s_suppkey")
    body = F.concat(F.lit("User-agent: x\nCrawl-delay: 9\n\nUser-agent: *\nCrawl-delay: "), F.when(k % 3 == 0, "soon").otherwise(F.format_string("%d.%d", F.floor(k / 2), (k % 2) * 5)), F.lit("\n"))
    return table(spark, d, "supplier").select("s_suppkey", robots.delay(body).alias("delay"))


@query("sitemap_lines", "SELECT s_suppkey, 'https://h' || s_suppkey || '.com/s.xml' AS url FROM supplier")
def sitemap_lines(spark, d):
    """Declared sitemaps on the host itself; other hosts and invalid addresses go."""
    body = F.concat(F.lit("User-agent: *\n  SiteMap: https://h"), "s_suppkey", F.lit(".com/s.xml\nSitemap: https://evil.com/x.xml\nsitemap: nowhere\nSitemap no colon"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("h"), "s_suppkey", F.lit(".com")).alias("host"), F.explode(robots.sitemap_lines(body)).alias("url"))
    return robots.of_host(rows, "url", "host", urls.BUILT_IN).select("s_suppkey", "url")


@query("robots_parse")
def robots_parse(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.explode(robots.parse_rules(F.concat(F.lit(_ROBOTS), F.lit("Disallow: /"), "s_name"))).alias("r")).select("s_suppkey", "r.*")


@query("sitemap_locs", "SELECT p_partkey, p_partkey % 4 = 0 AS is_index, 'https://example.com/' || p_partkey || '?a=1&b=2' AS loc FROM part UNION ALL SELECT p_partkey, p_partkey % 4 = 0, 'https://example.com/second' FROM part")
def sitemap_locs(spark, d):
    """Locations of gzipped and plain sitemaps on the host itself, and whether the file is an index."""
    k = F.col("p_partkey")
    xml = F.concat(F.when(k % 4 == 0, "<sitemapindex>").otherwise("<urlset>"), F.lit("<url><loc> https://example.com/"), k, F.lit("?a=1&amp;b=2</loc></url><url><LOC>https://example.com/second</LOC></url><loc>https://other.com/</loc><loc>mailto:x</loc>"))
    body = net.sitemap_body(F.when(k % 2 == 0, net.compress(xml)).otherwise(xml.cast("binary")))
    rows = _parts(spark, d).select("p_partkey", F.lit("example.com").alias("host"), body.alias("b")).select("p_partkey", "host", robots.is_sitemap_index(F.col("b")).alias("is_index"), F.posexplode(robots.sitemap_locs(F.col("b"))).alias("pos", "loc"))
    return robots.of_host(rows, "loc", "host", urls.BUILT_IN).where(F.col("pos") < robots.MAX_URLS).select("p_partkey", "is_index", "loc")


_ADDRESS = "SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS n FROM orders"


@query("public_ip", f"""SELECT o_orderkey, NOT ((n < 16777216) OR (n BETWEEN 167772160 AND 184549375) OR (n BETWEEN 1681915904 AND 1686110207) OR (n BETWEEN 2130706432 AND 2147483647) OR (n BETWEEN 2851995648 AND 2852061183)
  OR (n BETWEEN 2886729728 AND 2887778303) OR (n BETWEEN 3221225472 AND 3221225727) OR (n BETWEEN 3232235520 AND 3232301055) OR (n BETWEEN 3323068416 AND 3323199487) OR n >= 3758096384) AS public FROM ({_ADDRESS})""")
def public_ip(spark, d):
    """Addresses all over the IPv4 space, every second one as a mapped IPv6 address."""
    n = F.pmod(F.col("o_orderkey") * F.lit(2654435761), F.lit(4294967296))
    spelt = F.concat_ws(".", F.shiftrightunsigned(n, 24), F.shiftrightunsigned(n, 16) % 256, F.shiftrightunsigned(n, 8) % 256, n % 256)
    return table(spark, d, "orders").select("o_orderkey", net.public_ip(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("::ffff:"), spelt)).otherwise(spelt)).alias("public"))


@query("public_hosts", "SELECT l_suppkey AS host, bool_and(l_linenumber <> 7) AS public FROM lineitem GROUP BY 1")
def public_hosts(spark, d):
    """A host is public only if all its answers are."""
    answers = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("host"), F.when(F.col("l_linenumber") == 7, "10.0.0.1").otherwise("8.8.4.4").alias("address"))
    return net.public_hosts(answers)


@query("gzip_round_trip", "SELECT doc_id, md5(text) AS hash FROM documents")
def gzip_round_trip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(net.decompress(net.compress(F.col("text"))).cast("binary")).alias("hash"))


@query("search_engine_results", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'blocked' WHEN p_partkey % 5 = 1 THEN 'parse_error' ELSE 'ok' END AS status, CASE WHEN p_partkey % 5 > 1 THEN p_name END AS title, CASE WHEN p_partkey % 5 > 1 THEN 'https://a.com/' || p_partkey END AS url, CASE WHEN p_partkey % 5 > 1 THEN 'about captcha ' || p_brand END AS content, CASE WHEN p_partkey % 5 > 1 THEN 1 END AS position FROM part")
def search_engine_results(spark, d):
    """Headings of the main part; hidden, repeated and own links go; only the title tells a refusing page."""
    k = F.col("p_partkey") % 5
    cards = F.concat(F.lit("<div><h2><a href='https://a.com/"), "p_partkey", F.lit("'>"), "p_name", F.lit("</a></h2><p>about captcha "), "p_brand", F.lit("</p></div><div aria-hidden='true'><h2><a href='https://b.com/'>b</a></h2></div><div><h2><a href='https://x.engine.com/'>own</a></h2><h2><a href='//a.com/"), "p_partkey", F.lit("'>again</a></h2><h2><a href='https://u@c.com/'>user</a></h2></div>"))
    page = F.concat(F.lit("<title>"), F.when(k == 0, "Too many requests").otherwise("results"), F.lit("</title><main>"), F.when(k > 1, cards).otherwise("captcha"), F.lit("</main>"))
    return _parts(spark, d).select("p_partkey", engines.search_page(page, "demo", "engine.com").alias("r")).select("p_partkey", "r.status", F.explode_outer("r.results").alias("x")).select("p_partkey", "status", "x.title", "x.url", "x.content", "x.position")


@query("headline_results", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'no_results' ELSE 'ok' END AS status, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS title, CASE WHEN p_partkey % 4 > 0 THEN p_brand || ' 2h' END AS content, CASE WHEN p_partkey % 4 > 0 THEN '1970-01-01T00:00:' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || '+00:00' END AS published FROM part")
def headline_results(spark, d):
    """Cards of the headline section, with publisher and time."""
    card = F.concat(F.lit("<section><h2><a href='?searchheadlines=1'>h</a></h2><article class='x article-card'><a class='article-card__headline' href='https://c.news.com/A/"), "p_partkey", F.lit("?x'>"), "p_name", F.lit("</a><i class='article-publisher__name'>"), "p_brand", F.lit("</i><b data-timestamp='"), (F.col("p_partkey") % 60).cast("string"), F.lit("'>2h</b></article></section><section><h2><a href='?other'>o</a></h2><article class='article-card'><a class='article-card__headline' href='https://c.news.com/A/9'>other</a></article></section>"))
    nothing = F.lit("<title>News: x headlines | y</title><p>No articles were found matching x in the headline. Please try searching again.</p>")
    page = F.when(F.col("p_partkey") % 4 == 0, nothing).otherwise(card)
    return _parts(spark, d).select("p_partkey", engines.headline_page(page, "news", r"https://c\.news\.com/A/[0-9]+(?:\?\S*)?").alias("r")).select("p_partkey", "r.status", F.explode_outer("r.results").alias("x")).select("p_partkey", "status", "x.title", "x.content", F.col("x.publishedDate").alias("published"))


@query("encyclopedia_results", "SELECT p_partkey, 1 AS position, p_name AS title, 'https://en.example.org/wiki/' || p_partkey AS url, 'a & \"' || p_brand || '\"' AS content FROM part")
def encyclopedia_results(spark, d):
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("a &amp; &quot;<b>"), "p_brand", F.lit("</b>&quot;")).alias("excerpt"))).alias("pages")))
    return table(spark, d, "part").select("p_partkey", F.explode(engines.encyclopedia(body, "en.example.org")).alias("r")).select("p_partkey", "r.position", "r.title", "r.url", "r.content")


@query("engine_url", "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS own FROM part")
def engine_url(spark, d):
    k = F.col("p_partkey")
    url = F.concat(F.when(k % 4 == 0, "https://WWW.engine.com:443/").when(k % 4 == 1, "http://engine.com/").when(k % 4 == 2, "https://a@engine.com/").otherwise("https://engine.com/"), k.cast("string"))
    return table(spark, d, "part").select("p_partkey", engines.engine_url(url, "engine.com").alias("own"))


@query("json_results", with_views("SELECT item_id, title, inc FROM items", "items"))
def json_results(spark, d):
    """Rows to JSON and back."""
    spelt = view(spark, d, "items").select(F.to_json(F.struct("item_id", "title", "inc")).alias("j"))
    return spelt.select(F.from_json("j", "item_id bigint, title string, inc bigint").alias("r")).select("r.*")


def _stream(spark, df, scratch, name, parts=4):
    """A file stream over ``df`` in ``parts`` files that come in the order of its first column."""
    c = F.col(df.columns[0])
    cuts = [r[0] for r in df.select(F.explode(F.percentile_approx(c, F.array(*(F.lit(i / parts) for i in range(1, parts)))))).distinct().orderBy("col").collect() if r[0] is not None]
    edges = [None, *cuts, None]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):  # written one after the other, so that their times order them
        part = df.where((F.lit(True) if a is None else c > F.lit(a)) & (F.lit(True) if b is None else c <= F.lit(b)))
        part.coalesce(1).write.mode("overwrite").parquet(scratch.path(f"{name}/{i}"))
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(scratch.path(name))


def _run(stream, scratch, schema):
    """Append a stream to files until its input is used up, and the table of what it wrote."""
    stream.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return scratch.spark.read.schema(schema).parquet(scratch.path("out"))


@query("stream_rate_limit", "SELECT event_type AS bucket, user_id AS identifier, CAST(time_bucket(INTERVAL 1 day, ts) AS TIMESTAMP) AS window_start, count(*) AS requests, count(*) > 5 AS over_limit FROM events GROUP BY ALL")
def stream_rate_limit(spark, d):
    """Closed windows of a day; a last row far ahead closes those of the data and stays open itself."""
    scratch = Scratch(spark, "rates")
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("bucket"), F.col("user_id").alias("identifier"))
    end = rows.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", F.lit("end").alias("bucket"), F.lit(None).cast(rows.schema["identifier"].dataType).alias("identifier"))
    stream = _stream(spark, rows.unionByName(end), scratch, "in")
    counted = jobs.rate_limits(stream, {k: 5 for k in ("view", "signup", "error", "click", "purchase")}, 86400)
    return _run(counted, scratch, counted.schema).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_new_in_feed", "SELECT DISTINCT user_id AS item_id FROM events")
def stream_new_in_feed(spark, d):
    """An append feed: every item shows once, however often it was crawled within the watermark."""
    scratch = Scratch(spark, "feed")
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("item_id"))
    shown = jobs.new_in_feed(_stream(spark, rows, scratch, "in"), "400 days").select("item_id")
    return _run(shown, scratch, shown.schema)


@query("stream_recrawl", with_views(", s AS (SELECT *, coalesce(CAST(bucket <> lag(bucket) OVER w AS INT), 1) AS changed FROM requests WINDOW w AS (PARTITION BY identifier ORDER BY t, bucket)), i AS (SELECT *, sum(changed) OVER (PARTITION BY identifier ORDER BY t, bucket ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT identifier AS item_id, t, CAST(least(604800 * pow(2, least(row_number() OVER (PARTITION BY identifier, island ORDER BY t, bucket) - 1, 10)), 4838400) AS BIGINT) AS recrawl_after FROM i", "requests"))
def stream_recrawl(spark, d):
    """State that is carried over several triggers; the files come in the order of time."""
    scratch = Scratch(spark, "recrawl")
    rows = view(spark, d, "requests").select("t", F.col("identifier").alias("item_id"), F.col("bucket").alias("hash"))
    return _run(jobs.adaptive_recrawl(_stream(spark, rows, scratch, "in", 3)), scratch, T._parse_datatype_string(jobs.CRAWL_OUT))


@query("hang_strikes", with_views(", i AS (SELECT event_id, identifier AS item_id, t, bucket = 'purchase' OR bucket = 'view' AS finished, sum(CASE WHEN bucket = 'purchase' OR bucket = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY identifier ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM requests), n AS (SELECT *, sum(CASE WHEN finished THEN 0 ELSE 1 END) OVER (PARTITION BY item_id, island ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM i) SELECT event_id, item_id, t FROM n WHERE n = 3 AND NOT finished", "requests"))
def hang_strikes(spark, d):
    rows = view(spark, d, "requests").select("event_id", F.col("identifier").alias("item_id"), "t", F.col("bucket").isin("purchase", "view").alias("finished"))
    return jobs.strikes(rows)
