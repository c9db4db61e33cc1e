import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.functions import html, net, robots, text, urls
from webloom.operators import policy
from webloom.sources import engines


@pytest.mark.parametrize(
    "given, want",
    [
        ("http://shop.de", "https://shop.de/"),
        ("HTTP://Shop.DE:80/Kasse", "https://shop.de/Kasse"),
        ("https://shop.de:444/", "https://shop.de:444/"),
        ("https://me:pw@shop.de/", "https://shop.de/"),
        ("https://shop.de/p?utm_term=a&x=1&gclid=b", "https://shop.de/p?x=1"),
        ("https://shop.de/logo.SVG?cache=9&y=2", "https://shop.de/logo.SVG"),
        ("https://shop.de/svg?id=4", "https://shop.de/svg?id=4"),
        ("https://shop.de/?z=1&b=2&a=3", "https://shop.de/?a=3&b=2&z=1"),
        ("https://shop.de/?k=2&k=1", "https://shop.de/?k=2&k=1"),
        ("https://shop.de/?20=a&3=b&x=c", "https://shop.de/?3=b&20=a&x=c"),
        ("https://shop.de/große Karte", "https://shop.de/gro%C3%9Fe%20Karte"),
        ("https://shop.de/100%", "https://shop.de/100%25"),
        ("https://shop.de/x#teil", "https://shop.de/x"),
    ],
)
def test_canonical(given, want):
    assert urls.canonical(given) == want
    assert urls.canonical(want) == want


@pytest.mark.parametrize(
    "url, valid",
    [
        ("https://fr.wiki.org/", True), ("http://10.1.2.3/", False), ("http://[fd00::7]/", False), ("http://printer/", False), ("data:text/plain,x", False), ("tel:+491", False), ("", False), (None, False),
        ("https://" + "b" * 63 + ".net/", True), ("https://" + "b" * 64 + ".net/", False), ("https://" + "b." * 127 + "org/", False), ("https://a..org/", False), ("https://site.nosuchname/", False),
    ],
)
def test_valid(url, valid):
    assert urls.is_valid(url) is valid


def test_valid_by_list():
    assert urls.is_valid("https://mail.museum/", frozenset({"museum"})) and not urls.is_valid("https://site.org/", frozenset({"museum"}))


def test_oauth():
    assert urls.is_oauth("https://login.net/?response_type=token&client_id=7&redirect_uri=b")
    assert not urls.is_oauth("https://login.net/?redirect_uri=b&client_id=7")


@pytest.mark.parametrize(
    "ref, want",
    [("http://else.net/q", "https://else.net/q"), ("//cdn.io/f.js", "https://cdn.io/f.js"), ("/", "https://host.fr/"), ("next", "https://host.fr/x/y/next"), ("./", "https://host.fr/x/y/"), ("../../../up", "https://host.fr/up"), ("?page=2", "https://host.fr/x/y/z?page=2"), ("", "https://host.fr/x/y/z?p=1")],
)
def test_resolve(ref, want):
    assert urls.resolve("https://host.fr/x/y/z?p=1", ref) == want


@pytest.mark.parametrize(
    "host, want",
    [("x.y.shop.de", "shop.de"), ("shop.de", "shop.de"), ("m.gazette.co.uk", "gazette.co.uk"), ("uk", "uk"), ("co.jp", "co.jp"), ("a.b.c.kawasaki.jp", "b.c.kawasaki.jp"), ("office.city.kawasaki.jp", "city.kawasaki.jp"), ("one.two.ck", "one.two.ck"), ("x.www.ck", "www.ck"), ("deep.name.unlisted", "name.unlisted"), ("intranet", "intranet"), ("", ""), ("WWW.Shop.DE.", "shop.de")],
)
def test_registrable_domain(spark, host, want):
    assert urls.registrable_domain(host) == want
    rules = spark.createDataFrame([(r,) for r in urls.SUFFIXES], "rule string")
    assert urls.registrable_domains(spark.createDataFrame([(host,)], "host string"), "host", rules).first().domain == want


def _no(rules, path, known=True):
    return robots.disallowed(rules, known, path)


def test_robots_decisions():
    assert _no("User-agent: *\nAllow: /", "/a", known=False) and not _no("", "/a")
    assert not _no("Disallow: /a", "/a"), "rules outside any group are nobody's"
    one = "user-agent:*\ndisallow:/tmp\nallow:/tmp/open\nDisallow:\n"
    assert _no(one, "/tmp/x") and _no(one, "/tmpfile") and not _no(one, "/tmp/open/x") and not _no(one, "/other")
    ends = "User-agent: *\nDisallow: /*.zip$\nDisallow: /*&print="
    assert _no(ends, "/d/f.zip") and not _no(ends, "/d/f.zip?x") and _no(ends, "/a?b=1&print=1") and not _no(ends, "/a?print=1")
    tie = "User-agent: *\nDisallow: /page\nAllow: /page"
    assert not _no(tie, "/page1")
    several = "User-agent: a\nUser-agent: *\nDisallow: /one\nUser-agent: b\nDisallow: /two\n\nUser-agent: *\nDisallow: /three"
    assert _no(several, "/one") and not _no(several, "/two") and _no(several, "/three")
    closed = "User-agent: *\nSitemap: https://x.org/s\nUser-agent: b\nDisallow: /"
    assert not _no(closed, "/x"), "a field between agents starts a new group"
    stars = "User-agent: *\nDisallow: /s" + "*x" * 9
    assert _no(stars, "/something") and not _no(stars, "/t")
    long = "User-agent: *\n" + "".join(f"Allow: /n{i}\n" for i in range(1000)) + "Disallow: /late\n"
    assert not _no(long, "/late")


def test_unknown_hosts_allow_nothing(spark):
    paths = spark.createDataFrame([("a", "/x"), ("b", "/x"), ("c", "/x")], "host string, path string")
    rules = spark.createDataFrame([("a", "disallow", "/y", "^/y")], "host string, kind string, pattern string, regex string")
    states = spark.createDataFrame([("a", True), ("b", False)], "host string, known boolean")
    assert {r.host: r.disallowed for r in robots.decide(paths, rules, states).collect()} == {"a": False, "b": True, "c": True}
    assert {r.host: r.disallowed for r in robots.decide(paths, rules).collect()} == {"a": False, "b": False, "c": False}


def test_robots_bodies():
    assert robots.accept(b"Disallow: /a", "text/robots; charset=x") == "Disallow: /a" and robots.accept(b"", None) == ""
    assert robots.accept("﻿Allow: /".encode(), "text/plain") == "Allow: /"
    whole = b"Allow: /aaaa\n" * 40_000
    assert robots.accept(whole, "text/plain").endswith("/aaaa") and len(robots.accept(whole, "text/plain")) <= 500 * 1024
    for body, kind in [(b"GIF89a\x00", None), (b"Allow: /", "image/gif"), (b"Allow: \xc3\x28", "text/plain"), (b"a\x07b", "text/plain"), (b" <HTML><body>", "text/plain"), (b"Allow: /", "text/html"), (b"b" * 600_000, "text/plain")]:
        assert robots.accept(body, kind) is None
    assert [robots.crawl_delay("User-agent: *\n" + x) for x in ("Crawl-delay: 0.1", "crawl-delay: 0\nCrawl-Delay: 7", "Crawl-delay: x", "Crawl-delay: 1e2")] == [1, 7, None, 100]
    assert robots.crawl_delay("User-agent: b\nCrawl-delay: 3") is None


@pytest.mark.parametrize(
    "ip, public",
    [("1.1.1.1", True), ("10.255.0.9", False), ("172.31.255.255", False), ("172.15.0.1", True), ("192.168.0.10", False), ("127.9.9.9", False), ("0.1.2.3", False), ("169.254.1.1", False), ("100.63.255.255", True), ("100.127.0.1", False),
     ("192.0.0.8", False), ("192.0.1.1", True), ("198.19.255.255", False), ("198.17.0.1", True), ("239.1.1.1", False), ("250.0.0.1", False), ("203.0.113.7", True), ("[1.1.1.1]", False), ("1.1.1", False), ("1.1.1.256", False), ("", False), (None, False),
     ("::", False), ("::1", False), ("fe80::12", False), ("fdab::1", False), ("2001:db8:1::1", False), ("64:ff9b::102:304", False), ("::ffff:192.168.1.1", False), ("::ffff:1.1.1.1", True), ("2a00:1450::1", True), ("site.org", False)],
)
def test_public(ip, public):
    assert net.is_public(ip) is public


def test_page():
    page = html.read(
        "https://blog.org/a/b.html",
        """<html><head><title>  </title><meta name="twitter:title" content="From a card"><base href="/root/"><link rel="icon canonical" href="it?b=1&amp;a=2">
        <script type="application/ld+json">[{"description":"Of data","keywords":"k, l"}]</script></head>
        <body><section class="page-footer">Kept</section><ul><li>One<li>Two</ul><b hidden>x</b><i style="color:red;DISPLAY:none">x</i><i style="display:none;display:inline">Shown</i>
        <aside><a href="s">Side</a></aside><p id="top-nav">x</p><p class="ads">x</p><p class="cads">Words</p><a rel="ugc" href="u">u</a><a href="mailto:a@b.org">m</a><img alt="Map" src="m.png"></body></html>""",
    )
    assert (page["title"], page["description"], page["keywords"]) == ("From a card", "Of data", "k, l")
    assert page["canonical"] == "https://blog.org/root/it?a=2&b=1"
    assert [k["url"] for k in page["links"]] == ["https://blog.org/root/s"] and [k["url"] for k in page["images"]] == ["https://blog.org/root/m.png"]
    assert page["body"].split() == ["Kept", "One", "Two", "Shown", "Words", "um", "Map"]
    assert "One\n\nTwo" in page["body"] or "One\nTwo" in page["body"]
    assert html.read("https://blog.org/", '<a href="https://x.museum/">m</a>', frozenset({"museum", "org"}))["links"] and not html.read("https://blog.org/", '<a href="https://x.museum/">m</a>')["links"]


@pytest.mark.parametrize(
    "style, hidden",
    [("display:none", True), ("DISPLAY : NONE ", True), ("display:none;display:block", False), ("display:none!important;display:block", True), ("display:block ! important; display:none", False), ("display:none important", False), ("x:display:none", False), ("/* display:none */", False), ("display:/* a */none", True), ("content:';display:none'", False), ("", False)],
)
def test_hidden(style, hidden):
    assert html._hidden(style) is hidden


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<body><script>a</script><style>b</style><noscript>c</noscript><template>d</template><iframe>e</iframe><object>f</object><video>g</video><p hidden>h</p><p>Seen</p></body>", "Seen"),
        ("<body><header>h</header><nav>n<nav>m</nav></nav><aside>a</aside><footer>f</footer><div role='Banner x'>b</div><i role=search>s</i><i role=toolbar>t</i><main><p>Body</p></main></body>", "Body"),
        ("<body><main><header><h2>Head</h2></header><p>One</p></main><p>After</p></body>", "Head\n\nOne\n\nAfter"),
        ("<p>a&nbsp;b &lt;c&gt; <b>d</b>e</p>", "a b <c> de"),
        ("plain words", "plain words"),
        ("", ""),
        ("<body><div class='sidebar'>Kept by class</div><img alt='no alt text'></body>", "Kept by class"),
        ("<body><span aria-hidden='true'>Kept</span></body>", "Kept"),
        ("<body><article>A</article><article>B</article></body>", "A\n\nB"),
    ],
)
def test_article(markup, want):
    assert html.article(markup) == want


def test_charset_and_limits():
    assert html.decode("﻿ü".encode("utf-16-le")) == "ü" and html.decode("﻿ü".encode("utf-16-be"), "utf-8") == "ü"
    assert html.decode(b"<meta http-equiv=x content='text/html; charset=windows-1252'>\x80").endswith("€")
    assert html.decode(b"\xfc", "latin1") == "ü" and html.decode("ü".encode(), "no-such") == "ü"
    many = "<a rel='nofollow' href='/n'>n</a>" * 500 + "".join(f"<a href='/{i}'>x</a>" for i in range(10_050))
    got = html.read("https://blog.org/", many)["links"]
    assert len(got) == 10_000 and got[-1]["url"] == "https://blog.org/9999", "the limit counts links that are kept"
    assert len(html.read("https://blog.org/", "<p>" + "w " * 30_000 + "<a href='/x'>x</a></p>")["links"][0]["description"]) == 20_000
    assert html.directives(html.tree('<meta name="robots" content="NoFollow">')) == (False, True)
    assert html.space("a  b \t c\r\n\n\n\nd ") == "a  b c\n\nd"


def test_engine_pages():
    page = "<title>t</title><main><h2><a href='https://one.org/?utm_id=1'>One</a></h2><div hidden><h2><a href='https://two.org/'>2</a></h2></div><div><p>text</p><h2><a href='https://three.org'>Three</a></h2></div></main>"
    status, rows = engines.search_results(page, "e", "eng.com")
    assert status == "ok" and [(r["title"], r["url"], r["content"], r["position"]) for r in rows] == [("One", "https://one.org/", "", 1), ("Three", "https://three.org/", "text", 2)]
    assert engines.search_results("<title>Access denied</title>", "e", "eng.com") == ("blocked", [])
    assert engines.search_results("<p>access denied</p>", "e", "eng.com") == ("parse_error", [])
    assert len(engines.search_results("<main>" + "".join(f"<h2><a href='https://a.org/{i}'>{i}</a></h2>" for i in range(20)) + "</main>", "e", "eng.com")[1]) == 10
    assert [engines.outside_url(u, "eng.com") for u in ("https://eng.com/", "https://x.ENG.com/", "https://a:b@c.org/", "ftp://c.org/", "//c.org/d")] == [None, None, None, None, "https://c.org/d"]


def test_capped_text_and_files(spark):
    rows = spark.createDataFrame([(b"caf\xe9", "latin1"), (b"caf\xc3\xa9", None), (b" \n", None), (None, None)], "b binary, c string")
    assert [r[0] for r in rows.select(text.plain_text(F.col("b"), F.col("c"))).collect()] == ["café", "café", None, None]
    bodies = spark.createDataFrame([(net.gzip.compress(b"<loc>x</loc>"),), (b"plain",), (b"\x1f\x8bbroken",), (None,)], "b binary")
    assert [r[0] for r in bodies.select(net.sitemap_body(F.col("b"))).collect()] == ["<loc>x</loc>", "plain", "", None]


def test_policies(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(policy.below_host(F.lit("a.Ads.net."), F.array(F.lit("ads.net")))) and not value(policy.below_host(F.lit("bads.net"), F.array(F.lit("ads.net"))))
    assert not value(policy.write_allowed(F.lit(-1.0), F.lit(10.0), 0)) and not value(policy.write_allowed(F.lit(11.0), F.lit(10.0), 0)) and value(policy.write_allowed(F.lit(1.0), F.lit(10.0), 1))
    assert not value(policy.crawl_allowed(F.lit(None), F.lit(True), F.lit("x"), F.lit(0)))
    cache = policy.PoolCache(most=5)
    calls = []
    made = lambda: calls.append(1) or one
    for version, q, n in ((1, "a", 5), (1, "a", 5), (1, "b", 5), (2, "a", 5), (2, "a", 6), (2, "a", 6)):
        cache.get(version, q, n, made)
    assert len(calls) == 5


SLOW = ("page_metadata", "page_text", "page_links", "article_text", "link_admission", "made_page_metadata", "made_page_text", "made_article_text", "made_link_admission", "search_engine_results", "headline_results", "challenge_page", "charset_sources", "reextraction", "canonical_url", "resolve_url")


@pytest.mark.parametrize("name", SLOW)
def test_slow_python_runs_above_the_repartition(spark, name):
    """A file of one row group is spread over the cores first, and no inferred filter reads pages below that."""
    import __spark_entry__

    rows = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    below = [part.split("Relation [")[0] for part in plan.split("Repartition")[1:]]
    assert below and not any("ArrowEvalPython" in b for b in below), plan


def test_pages_are_read_in_pieces():
    rows = pd.Series(["x" * 10] * 600 + [None, "y" * 9_000_000, "z"])
    cuts = list(html.pieces(rows))
    assert [i for c in cuts for i in range(len(rows))[c]] == list(range(len(rows)))
    assert max(c.stop - c.start for c in cuts) <= html.PIECE_ROWS and slice(601, 602) in cuts


def test_wanted_parts_are_those_of_the_whole():
    page = "<base href='/q/'><title>t</title><meta name=description content=d><link rel=canonical href=c><p class=ad>x</p><p>y <a href=l>k</a><img src=i.png></p>"
    whole = html.read("https://h.com/", page)
    for wanted in (("title",), ("canonical", "noindex"), ("links",), ("images", "body")):
        assert html.read("https://h.com/", page, wanted=wanted) == {p: whole[p] for p in wanted}
