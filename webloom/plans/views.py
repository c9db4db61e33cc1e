"""The driver's tables shaped into a crawl catalogue, as SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")
NOW = 820454400  # 1996-01-01 00:00:00 UTC: "now" of every time-dependent query on orders

VIEWS: dict[str, str] = {
    "item_host": "SELECT l_partkey AS item_id, MIN(l_suppkey) AS host_id FROM lineitem GROUP BY l_partkey",
    "hosts": "SELECT s_suppkey AS host_id, s_name AS host, CAST(s_nationkey AS VARCHAR(10)) AS domain FROM supplier",
    "links": """SELECT o.o_custkey AS parent_id, l.l_partkey AS child_id, MIN(o.o_orderpriority || ' ' || p.p_name) AS description
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
        GROUP BY o.o_custkey, l.l_partkey""",
    "edges": """SELECT k.parent_id, k.child_id, CAST(c.c_nationkey AS VARCHAR(10)) AS domain,
        CASE WHEN CAST(c.c_nationkey AS VARCHAR(10)) <> h.domain THEN 1 ELSE 0 END AS external, k.description
        FROM links k JOIN customer c ON k.parent_id = c.c_custkey JOIN item_host i ON k.child_id = i.item_id JOIN hosts h ON i.host_id = h.host_id""",
    "inbound": "SELECT child_id AS item_id, COUNT(*) AS inc FROM links GROUP BY child_id",
    "items": """SELECT p.p_partkey AS item_id, 'https://example.com/p/' || CAST(p.p_partkey AS VARCHAR(20)) AS url, ih.host_id, p.p_name AS title, p.p_type AS description, p.p_brand AS full_text,
        CASE WHEN p.p_partkey % 10 = 0 THEN 'image/jpeg' WHEN p.p_partkey % 10 = 1 THEN 'application/pdf' WHEN p.p_partkey % 10 = 2 THEN 'text/plain' ELSE 'text/html' END AS type,
        CASE WHEN p.p_size % 11 = 0 THEN 1 ELSE 0 END AS noindex,
        CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE 1700000000 + p.p_partkey * 60 END AS crawled_time,
        COALESCE(b.inc, 0) AS inc
        FROM part p LEFT JOIN item_host ih ON p.p_partkey = ih.item_id LEFT JOIN inbound b ON p.p_partkey = b.item_id""",
    "frontier": """SELECT o_orderkey AS item_id, o_custkey AS host_id,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 255 ELSE 0 END AS priority,
        CASE WHEN o_orderstatus = 'F' THEN 788918400 + (o_orderkey * 7919) % 31536000 END AS crawled_time,
        604800 * (1 + o_orderkey % 8) AS recrawl_after,
        CASE WHEN o_orderstatus = 'P' THEN 820454400 + (o_orderkey * 131) % 600 - 300 END AS claimed_until,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 820454400 + (o_custkey * 37) % 7200 - 3600 END AS next_crawl
        FROM orders""",
    "docs": """SELECT d.doc_id, d.text AS full_text, d.source, COALESCE(l.toxic, 0) AS noindex FROM documents d
        LEFT JOIN (SELECT doc_id, MAX(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "requests": "SELECT event_id, event_type AS bucket, user_id AS identifier, CAST(FLOOR(EXTRACT(EPOCH FROM ts)) AS BIGINT) AS t FROM events",
}
_NEEDS = {"links": (), "edges": ("links", "item_host", "hosts"), "inbound": ("links",), "items": ("item_host", "links", "inbound"), "docs": (), "requests": ()}
#: The same tables with fewer shuffles: lineitems meet their orders (which bring the domains of their customer along, as a list, since an edge
#: has a row for each of them), are dealt out by part once, and all that follows stays there. EXTRACT(EPOCH ...) is spelt differently.
_SPARK = {
    "links": """SELECT k.o_custkey AS parent_id, k.l_partkey AS child_id, MIN(k.o_orderpriority || ' ' || p.p_name) AS description
        FROM (SELECT /*+ REPARTITION(l_partkey) */ o_custkey, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey) k JOIN part p ON k.l_partkey = p.p_partkey
        GROUP BY k.o_custkey, k.l_partkey""",
    "edges": """SELECT parent_id, child_id, domain, CASE WHEN domain <> child_domain THEN 1 ELSE 0 END AS external, description
        FROM (SELECT e.parent_id, e.child_id, e.description, h.child_domain, explode(transform(split(e.domains, ','), d -> nullif(d, ''))) AS domain
        FROM (SELECT k.o_custkey AS parent_id, k.l_partkey AS child_id, MIN(k.o_orderpriority || ' ' || p.p_name) AS description, FIRST(k.domains) AS domains
        FROM (SELECT /*+ REPARTITION(l_partkey) */ o_custkey, l_partkey, o_orderpriority, domains FROM lineitem JOIN (SELECT o_orderkey, o_custkey, o_orderpriority, domains
        FROM orders JOIN (SELECT c_custkey, concat_ws(',', collect_list(coalesce(CAST(c_nationkey AS STRING), ''))) AS domains FROM customer GROUP BY c_custkey) ON o_custkey = c_custkey) ON l_orderkey = o_orderkey) k
        JOIN part p ON k.l_partkey = p.p_partkey GROUP BY k.o_custkey, k.l_partkey) e
        JOIN (SELECT i.item_id, h.domain AS child_domain FROM item_host i JOIN hosts h ON i.host_id = h.host_id) h ON e.child_id = h.item_id)""",
    "requests": "SELECT event_id, event_type AS bucket, user_id AS identifier, CAST(unix_timestamp(CAST(ts AS TIMESTAMP)) AS BIGINT) AS t FROM events",
}


def order(names: tuple[str, ...]) -> list[str]:
    """``names`` and what they need, each after its needs."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return out


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL: ``sql`` (which may start with further CTEs ", x AS (...) SELECT") over the named views."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order(names))
    return f"WITH {ctes} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue table over the driver's tables of ``sf_dir``."""
    needed = order((name,))
    ctes = ", ".join(f"{n} AS ({_SPARK.get(n, VIEWS[n])})" for n in needed)
    sql = f"WITH {ctes} SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any(f" {t}" in _SPARK.get(n, VIEWS[n]).replace("\n", " ") for n in needed)}
    marks = {t: "{" + t + "}" for t in used}
    import re

    for t, m in marks.items():
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {m}", sql)
    return spark.sql(sql, **used)
