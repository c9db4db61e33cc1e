import itertools
import random

from webloom.functions import text
from webloom.operators import catalogue, frontier, mutations, search
from webloom.session import Scratch
from webloom.streaming import jobs
from pyspark.sql import functions as F


def test_match_expression():
    assert search.match_expression('red widget') == "red | widget"
    assert search.match_expression('"red widget" blue') == '"red widget" | blue'
    assert search.match_expression("a-b (c)") == "a | b | c"
    assert search.match_expression('+-()"') == ""
    assert search.first_search_word("a of widget") == "widget"


def _items(spark, rows):
    return spark.createDataFrame([(i, 0, t, "", "", "text/html") for i, t in rows], "item_id long, inc long, title string, description string, full_text string, type string")


def test_index_follows_the_store(spark):
    index = search.item_index(Scratch(spark, "index"))
    index.rebuild(search.indexable(_items(spark, [(1, "red fox"), (2, "red red hen"), (3, "blue"), (4, None)])))
    assert search.content_pool(index, "---").count() == 0
    assert [r.item_id for r in search.content_pool(index, "red").collect()] == [2, 1]
    index.upsert(search.indexable(_items(spark, [(3, "red sky"), (5, "fox")])), gone=_items(spark, [(1, "")]), counts=spark.createDataFrame([(2, 9)], "item_id long, inc long"))
    index = search.item_index(index.scratch)  # another reader finds the same state in storage
    for _ in range(2):
        assert {r.item_id: r.inc for r in search.content_pool(index, "red fox").collect()} == {2: 9, 3: 0, 5: 0}
        assert index.statistics().first().n == 4
        index.compact()
    fresh = search.item_index(Scratch(spark, "index"))
    fresh.rebuild(search.indexable(_items(spark, [(2, "red red hen"), (3, "red sky"), (4, None), (5, "fox")])).withColumn("inc", F.when(F.col("item_id") == 2, 9).otherwise(0).cast("long")))
    assert search.content_pool(fresh, '"red sky" hen').collect() == search.content_pool(index, '"red sky" hen').collect()
    index.truncate()
    assert index.version() == -1


def test_sync_survives_a_restart(spark):
    s = Scratch(spark, "restart")
    edge = lambda *r: spark.createDataFrame(list(r), "parent_id long, child_id long, domain string, external int, description string")
    own, links = search.item_index(s), search.link_index(s)
    own.rebuild(search.indexable(_items(spark, [(1, "a")])))
    links.rebuild(edge((1, 2, "x", 1, "old"), (3, 1, "y", 1, "in")))
    asked = spark.createDataFrame([(1, 1, 1), (2, 2, 0)], "item_id long, sync_item int, sync_links int")
    make = lambda: jobs.IndexSync(search.item_index(s), search.link_index(s), lambda: _items(spark, [(1, "b"), (2, "c")]), lambda: edge((1, 2, "x", 1, "new"), (4, 1, "z", 0, "other")))
    make().apply(asked, 7)
    version = own.version()
    make().apply(asked, 7)
    assert own.version() == version, "a batch that was applied is known after a restart"
    assert sorted(r.item_id for r in search.content_pool(own, "b c").collect()) == [1, 2] and search.content_pool(own, "a").count() == 0
    assert sorted(map(tuple, links.live().select("parent_id", "child_id", "external").collect())) == [(1, 2, 1), (4, 1, 0)]


def test_term_cap(spark):
    rows = [(1, "widget " * 60 + "end"), (2, "the " * 180 + "x"), (3, "widgets-" * 400), (4, "a\nb c"), (5, ""), (6, None), (7, "Éa éA-b\n" * 40 + "éa z"), (1, "word")]
    out = [r.t for r in spark.createDataFrame(rows, "id long, t string").coalesce(1).select(text.capped(F.col("t")).alias("t")).collect()]
    assert out[0].split() == ["widget"] * 50 + ["end"]
    assert out[1] == rows[1][1] and out[2] == "" and out[3] == "a\nb c" and out[4] == "" and out[5] is None and out[7] == "word"
    assert out[6] == rows[6][1], "terms of two letters are never capped"


def test_truncate(spark):
    df = spark.createDataFrame([(None,), ("short",), ("word " * 30,), ("x" * 50,), ("y" * 20,)], "t string")
    out = [r[0] for r in df.select(text.truncate(F.col("t"), 20)).collect()]
    assert out == [None, "short", "word word word word…", "x" * 20 + "…", "y" * 20]


def _sequential(rows, now, k):
    """Literal picks one by one; rows: dicts of the frontier."""
    hosts = {r["host_id"]: r["next_crawl"] for r in rows}
    done, out = set(), []
    for _ in range(k):
        best = None
        for r in rows:
            if r["item_id"] in done:
                continue
            ready = r["priority"] > 0 or hosts[r["host_id"]] is None or hosts[r["host_id"]] <= now
            if not ready:
                continue
            free = r["claimed_until"] is None or r["claimed_until"] <= now
            if r["crawled_time"] is None and r["claimed_until"] is None:
                key = (0, -r["priority"], r["item_id"])
            elif r["crawled_time"] is not None and r["crawled_time"] + r["recrawl_after"] <= now and free:
                key = (1, r["crawled_time"] + r["recrawl_after"], r["item_id"])
            elif r["crawled_time"] is None and r["claimed_until"] is not None and r["claimed_until"] <= now:
                key = (2, 0, r["item_id"])
            else:
                continue
            if best is None or key < best[0]:
                best = (key, r)
        if best is None:
            break
        done.add(best[1]["item_id"])
        out.append(best[1]["item_id"])
        if best[1]["priority"] == 0:
            hosts[best[1]["host_id"]] = now + 60
    return out


def test_batch_equals_sequential(spark):
    rnd, now = random.Random(4), 1000
    for _ in range(6):
        rows = []
        hosts = {h: rnd.choice([None, 900, 1000, 1100]) for h in range(4)}
        for i in range(18):
            h = rnd.randrange(4)
            rows.append(dict(item_id=i, host_id=h, priority=rnd.choice([0, 0, 0, 255]), crawled_time=rnd.choice([None, None, 100, 950]), recrawl_after=rnd.choice([50, 900]), claimed_until=rnd.choice([None, None, 990, 1200]), next_crawl=hosts[h]))
        df = spark.createDataFrame([tuple(r.values()) for r in rows], "item_id long, host_id long, priority int, crawled_time long, recrawl_after long, claimed_until long, next_crawl long")
        assert [r.item_id for r in frontier.batch(df, now, 9).collect()] == _sequential(rows, now, 9)


def test_counters_and_queue(spark):
    q = spark.createDataFrame([(1, 2, 0), (1, 1, 2), (2, 0, 0), (2, 2, 1)], "item_id long, sync_item int, sync_links int")
    assert sorted(map(tuple, mutations.coalesce_queue(q).collect())) == [(1, 1, 2, 2), (2, 2, 1, 2)]


def test_chained_merges(spark):
    pairs = [(2, 1), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (21, 20), (22, 21), *((i, i + 1) for i in range(100, 140))]
    ends = dict(map(tuple, mutations.last_survivors(spark.createDataFrame(pairs, "old_id long, new_id long")).collect()))
    assert ends == {2: 1, 3: 1, 9: 5, 8: 5, 7: 5, 6: 5, 21: 20, 22: 20, **{i: 140 for i in range(100, 140)}}
    links = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (1, 3, "c"), (4, 3, "d"), (4, 2, "a0"), (4, 1, "z")], "parent_id long, child_id long, description string")
    out = mutations.merge_links(links, spark.createDataFrame([(2, 1), (3, 1)], "old_id long, new_id long"))
    assert sorted(map(tuple, out.collect())) == [(4, 1, "z")], "an edge that was there keeps its description"


def test_redirect(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    before = mutations.Catalogue(
        df([(1, "a", 1, 0), (2, "b", 1, 255), (3, "c", 1, 7), (4, "d", 1, 0)], "item_id long, url string, host_id long, priority int"),
        df([(4, 2, "x"), (2, 4, "y"), (1, 2, "self"), (2, 1, "self")], "parent_id long, child_id long, description string"),
        df([(50, 2)], "request_id long, item_id long"), df([(60, 2)], "source_id long, target_id long"), df([("a",), ("free",), ("z",)], "url string"),
    )
    after = mutations.redirect(before, df([(2, "a", 9), (3, "free", 9), (4, "free", 9)], "item_id long, new_url string, new_host_id long"))
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert rows(after.items) == [(1, "a", 1, 255), (3, "free", 9, 7)]
    assert rows(after.links) == [(1, 3, "y"), (3, 1, "x")]
    assert rows(after.requests) == [(50, 1)] and rows(after.aliases) == [(2, 1), (60, 1)] and rows(after.dead) == [("z",)]


def test_tables_may_be_empty(spark):
    none = spark.createDataFrame([], "parent_id long, child_id long, description string")
    assert mutations.merge_links(none, spark.createDataFrame([], "old_id long, new_id long")).count() == 0
    assert catalogue.union_ids(spark.createDataFrame([], "id long")).count() == 0


def test_scratch_reads_what_it_wrote(spark):
    s = Scratch(spark, "t")
    assert s.save(spark.range(5), "x").count() == 5
    s.drop()
    assert list(itertools.islice(iter(()), 1)) == []


def test_last_hour_ends_to_the_microsecond(spark, tmp_path):
    import __spark_entry__

    stamps = ["10:59:59.999999", "11:00:00", "12:00:00", "12:00:00.000001", "12:00:00.9"]
    spark.createDataFrame([(f"2024-01-15 {s}",) for s in stamps], "ts string").select(F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert __spark_entry__.queries()["crawled_last_hour"](spark, str(tmp_path)).first().crawled == 2


def test_crawled_texts_are_not_broadcast(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["mark_crawled"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_postings_need_no_shuffle_and_no_join(spark):
    """Repeated words, words of one row alone, empty rows; a fresh index is read without its live rows, a changed one with them."""
    index = search.item_index(Scratch(spark, "spelt"))
    rows = search.indexable(_items(spark, [(1, "b a b c a b"), (2, "x"), (3, ""), (4, None)]))
    spelt = index._spelt(rows)
    assert "Exchange" not in spelt._jdf.queryExecution().executedPlan().toString()
    want = [(1, 6, "a", [1, 4]), (1, 6, "b", [0, 2, 5]), (1, 6, "c", [3]), (2, 1, "x", [0])]
    got = lambda r: sorted(map(tuple, r.select("item_id", "dl", "term", "positions").collect()))
    assert got(spelt) == want
    index.rebuild(rows)
    assert got(index.held()) == want and "Join" not in index.terms({"a"})._jdf.queryExecution().executedPlan().toString()
    index.upsert(search.indexable(_items(spark, [(2, "a a")])))
    assert got(index.held()) == [*want[:3], (2, 2, "a", [0, 1])]
    assert sorted(r.item_id for r in index.terms({"a"}).collect()) == [1, 2]


def test_edges_of_repeated_customers(spark, tmp_path):
    """Edges equal the SQL where a customer key has two rows, no nation, or a lineitem no order."""
    import duckdb
    from webloom.plans.views import view, with_views

    made = {
        "customer": ([(1, 3), (1, 4), (2, None), (5, 3)], "c_custkey long, c_nationkey int"),
        "orders": ([(10, 1, "1-URGENT"), (11, 1, "5-LOW"), (12, 2, "5-LOW"), (13, 9, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(10, 7, 1), (11, 7, 2), (12, 7, 1), (12, 8, 2), (13, 7, 1), (99, 7, 0), (10, 6, 1)], "l_orderkey long, l_partkey long, l_suppkey long"),
        "part": ([(7, "red bolt"), (8, None), (7, "blue bolt")], "p_partkey long, p_name string"),
        "supplier": ([(0, "s", 3), (2, "t", 5)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    with duckdb.connect() as c:
        for name in made:
            c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        for name in ("links", "edges"):
            want = c.execute(with_views(f"SELECT * FROM {name}", name)).fetchall()
            assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in view(spark, str(tmp_path), name).collect())
