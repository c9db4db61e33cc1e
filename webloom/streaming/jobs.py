"""Structured Streaming jobs: rate limits, index synchronisation, feeds and per-item state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators import search
from webloom.operators.index import SearchIndex
from webloom.operators.mutations import coalesce_queue

# fixed values: requests a minute
LIMITS = {"client": 60, "address": 300, "login": 5, "thumb_client": 1000, "thumb_address": 2000}


def rate_limits(requests: DataFrame, limits: dict[str, int], seconds: int = 60, late: str = "180 seconds") -> DataFrame:
    """Requests per bucket, identifier and tumbling window, and whether the limit is passed.

    ``requests`` has ts (timestamp), bucket and identifier. A window comes out once it is older
    than ``late`` (append mode), its state is let go then, and rows that come for it later are
    dropped: feed files in time order where that matters.
    """
    table = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
    timed = requests.withWatermark("ts", late) if requests.isStreaming else requests
    counted = timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "bucket", "identifier").agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("bucket", "identifier", F.col("w.start").alias("window_start"), "requests", (F.col("requests") > F.coalesce(table[F.col("bucket")], F.lit(2**31 - 1))).alias("over_limit"))


def request_budgets(requests: DataFrame, client: int = LIMITS["client"], address: int = LIMITS["address"], seconds: int = 60) -> DataFrame:
    """Every request with its number in the window of its client and of its address, and the seconds to wait if either budget is passed.

    ``requests``: event_id, client, address, t. Both counters grow with every request, refused ones too.
    """
    start = F.floor(F.col("t") / seconds) * seconds
    nth = lambda c: F.row_number().over(Window.partitionBy(c, "w").orderBy("t", "event_id"))
    counted = requests.withColumn("w", start).withColumns({"client_n": nth("client"), "address_n": nth("address")})
    over = (F.col("client_n") > client) | (F.col("address_n") > address)
    return counted.select("event_id", "client_n", "address_n", F.when(over, F.greatest(F.lit(1), F.col("w") + seconds - F.col("t"))).cast("long").alias("retry_after"))


def new_in_feed(items: DataFrame, late: str = "1 hour") -> DataFrame:
    """An append feed in which every item_id shows once (ts: crawl time)."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark(["item_id"])


#: Requests of one batch whose ids are broadcast; larger batches are joined by sorting.
BROADCAST_IDS = 8_000_000


class IndexSync:
    """Keeps the written indexes equal to a rebuild of the store, from batches of coalesced requests.

    Requests carry item_id, sync_item (1: whole row, 2: count only) and sync_links (1: all edges of
    the item, 2: outgoing ones). Rows that the store lacks go; a count-only request for a row that
    the index lacks is widened to a whole one. The ids of applied batches are files beside the
    index, so a restarted job knows them; a batch that was cut short is applied again, which changes
    nothing as rows are replaced by key.
    """

    def __init__(self, items: SearchIndex, links: SearchIndex, store: Callable[[], DataFrame], edges: Callable[[], DataFrame]):
        self.items, self.links, self.store, self.edges = items, links, store, edges

    def _mark(self, batch_id: int):
        scratch = self.items.scratch
        path = scratch.spark._jvm.org.apache.hadoop.fs.Path(scratch.path(f"{self.items.name}-applied/{batch_id}"))
        return path, path.getFileSystem(scratch.spark._jsc.hadoopConfiguration())

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        path, fs = self._mark(batch_id)
        if fs.exists(path):
            return
        wanted = coalesce_queue(batch).persist()
        own = wanted.where("sync_item > 0").select("item_id", "sync_item")
        there = self.items.live().select("item_id", F.lit(True).alias("there"))
        coded = search.indexable(self.store()).join(own, "item_id").join(there, "item_id", "left")
        whole = coded.where("sync_item = 1 or there is null")
        counts = coded.where("sync_item = 2 and there").select("item_id", "inc")
        gone = own.join(self.store().select("item_id"), "item_id", "left_anti")
        self.items.upsert(whole, gone, counts)
        outgoing = wanted.where("sync_links > 0").select(F.col("item_id").alias("parent_id"))
        incoming = wanted.where("sync_links = 1").select(F.col("item_id").alias("child_id"))
        if wanted.count() <= BROADCAST_IDS:
            outgoing, incoming = F.broadcast(outgoing), F.broadcast(incoming)

        def edges_of(e: DataFrame, touched: bool) -> DataFrame:
            """Edges that the requests ask for, or the others: told by their ends, whatever table they come from."""
            told = e.join(outgoing.withColumn("__out", F.lit(True)), "parent_id", "left").join(incoming.withColumn("__in", F.lit(True)), "child_id", "left")
            return told.where(F.coalesce("__out", "__in", F.lit(False)) == touched).select(*e.columns)

        self.links.upsert(edges_of(self.edges(), True), stays=lambda live: edges_of(live, False))
        wanted.unpersist()
        fs.create(path, True).close()

    def run(self, requests: DataFrame, checkpoint: str):
        return requests.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CRAWL_STATE = "hash string, interval bigint"
CRAWL_OUT = "item_id bigint, t bigint, recrawl_after bigint"


def _fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before, interval = state.get if state.exists else (None, 0)
    frames = pd.concat(list(rows)).sort_values(["t", "hash"])
    out = []
    for t, h in zip(frames["t"], frames["hash"]):
        interval = min(2 * interval, 4838400) if h == before else 604800
        before = h
        out.append((key[0], t, interval))
    state.update((before, interval))
    yield pd.DataFrame(out, columns=["item_id", "t", "recrawl_after"])


def adaptive_recrawl(crawls: DataFrame) -> DataFrame:
    """The interval after every crawl (item_id, t, hash), carried as state of the item.

    Within a trigger an item's rows are taken in time order; the state is one hash and one number.
    """
    return crawls.groupBy("item_id").applyInPandasWithState(_fold, CRAWL_OUT, CRAWL_STATE, "append", GroupStateTimeout.NoTimeout)


def strikes(kills: DataFrame, most: int = 3) -> DataFrame:
    """item_id, t where an item was killed ``most`` times in a row (a finished run clears)."""
    order = Window.partitionBy("item_id").orderBy("t", "event_id")
    island = kills.withColumn("island", F.sum(F.col("finished").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum((~F.col("finished")).cast("int")).over(Window.partitionBy("item_id", "island").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("n", n).where(F.col("n") == most).select("event_id", "item_id", "t")
