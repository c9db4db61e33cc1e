"""Nearest neighbours by largest inner product: inverted file with exact bounds, whole vectors scored in double precision.

Coarse centroids are fitted in numpy on at most ``TRAIN_ROWS`` vectors; every vector is indexed
under its nearest centroid, and each list knows the largest distance of a vector from its centroid.
A query takes a floor from the training sample: the score of its (k + 1)-th best vector there (one
may be its own). It skips a list only if no vector there can reach the floor: inner product with the
centroid plus the query's length times the list's radius. So nothing that belongs to the result is
left out, whatever the vectors look like; without clusters no list is skipped, and cost grows with
queries times rows. For the floor a query looks at the sample's vectors in the lists it probes first
(in the order of its inner product with their centroids: ``PROBES`` at least, ``LEAST_SEEN`` vectors
at least, and as many as hold ``RECALL`` of the nearest neighbours within the sample).

Equal vectors are indexed once, with their ``k + 1`` smallest ids: no further copy can be
among the k nearest, since equal scores go to the smaller id. Vectors lie in order of their lists
and are cut into even parts, crowded lists too; queries are dealt out in slices. A task holds a
slice of queries (``SHEETS_AT_ONCE`` sheets at most) with the best ``RERANK`` vectors of each so far
(or those of k + 1 ids, if that is more), and the vectors of a part stream past in blocks of ``BLOCK``.
So a query sends as many rows from each part at most, and the number of parts follows the cluster's
cores, not the rows: rows sent grow with the queries, not with queries times blocks. The last scores
are sums in the order of components, so that blocks do not change them.

Cases: null vectors, zero vectors and vectors with null or non-finite components take no part;
rows with a null id take no part; shorter vectors count as if zeros followed; rows of one id are
one candidate with its largest score, and one query with the smallest of its vectors (compared
component by component); a query never finds its own id; fewer than k candidates -> all of them;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import Scratch

TRAIN_ROWS = 20_000
LISTS_MOST = 1_024
PER_LIST = 400
PROBES = 24
LEAST_SEEN = 2_000
#: Share of the sample's nearest neighbours whose lists are probed for a floor, and the sample's queries and neighbours.
RECALL = 0.995
SAMPLE_QUERIES, SAMPLE_NEAREST = 500, 20
#: Vectors that a query keeps; scores are exact already, so the margin is for the last digits alone.
RERANK = 40
BLOCK = 8_192
QUERY_BLOCK = 256
#: Sheets of queries that one task holds.
SHEETS_AT_ONCE = 64
#: Tasks (slices of queries times parts of the vectors) that a search is dealt out to, if it has as many sheets or blocks; twice the cluster's cores, if that is more.
CELLS = 32
#: Slices for the root of the tasks: vectors travel once for a slice, queries and candidates once for a part, about as many bytes (an estimate for 64 dimensions and one query in 20 rows).
SLICES_OF_ROOT = 1
#: Bytes of vectors that travel in one row, and of the sample that floors are taken from.
PACK_BYTES, FLOOR_BYTES = 4_096, 32_000_000


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dim
    probes: int = PROBES

    def probed(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """queries x lists: whether the query probes the list first."""
        order = np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")
        seen = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (np.arange(order.shape[1]) < self.probes) | (seen < LEAST_SEEN), 1)
        return out & (sizes > 0)

    def floors(self, x: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k others reach: the (k + 1)-th best of the sample (one vector to an id) in the lists probed first."""
        out = np.full(len(x), -np.inf)
        if len(sample) > k:
            lists = nearest(sample, self.centroids)
            sizes = np.bincount(lists, minlength=len(self.centroids))
            for a in range(0, len(x), QUERY_BLOCK):
                block = x[a : a + QUERY_BLOCK]
                score = np.where(self.probed(block, sizes)[:, lists], block @ sample.T, -np.inf)
                out[a : a + QUERY_BLOCK] = -np.partition(-score, k, axis=1)[:, k]
        return out

    def reached(self, x: np.ndarray, floors: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """queries x lists: whether a vector of the list may reach the query's floor (if numbers overflow, it may); ``radii`` are negative for empty lists."""
        centroids = self.centroids.astype(np.float64)
        length = np.sqrt((x * x).sum(1))[:, None]
        slack = 1e-9 * length * (np.sqrt((centroids * centroids).sum(1)) + np.abs(radii))
        return ~(x @ centroids.T + length * radii + slack < floors[:, None]) & ~(radii < 0)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        sums = np.column_stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])])
        centres[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
        empty = np.flatnonzero(count == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4_096) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(x[a : a + rows] @ centres.T - half).argmax(1) for a in range(0, len(x), rows)]) if len(x) else np.zeros(0, np.int64)


def fit(sample: np.ndarray, total: int, seed: int = 3) -> Quantiser:
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(LISTS_MOST, total // PER_LIST, len(sample) // 8)))
    centroids = kmeans(sample, lists, 12, rng)
    return Quantiser(centroids, probes_for(sample, centroids, rng))


def probes_for(sample: np.ndarray, centroids: np.ndarray, rng: np.random.Generator) -> int:
    """Lists that a query probes first to meet RECALL of its nearest neighbours within the sample."""
    if len(sample) < 2:
        return PROBES
    who = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    score = sample[who] @ sample.T
    score[np.arange(len(who)), who] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(SAMPLE_NEAREST, len(sample) - 1)]
    place = np.argsort(np.argsort(-(sample[who] @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(sample, centroids)[near], 1), axis=None) + 1
    return max(PROBES, int(needed[int(np.ceil(RECALL * len(needed))) - 1]))


class Best:
    """The ``keep`` vectors nearest to each of some queries, while vectors are met block by block."""

    def __init__(self, x: np.ndarray, reached: np.ndarray, keep: int):
        self.x, self.reached, self.keep = x, reached, keep
        self.near = np.full((len(x), keep), -np.inf)
        self.head = None  # queries x keep, meaningful where near is finite

    def meet(self, lists: np.ndarray, vectors: np.ndarray, heads: np.ndarray) -> None:
        """``lists`` is in order."""
        keep = self.keep
        if self.head is None:
            self.head = np.zeros(self.near.shape, heads.dtype)
        numbers, starts = np.unique(lists, return_index=True)
        ends = np.append(starts[1:], len(lists))
        asking = np.flatnonzero(self.reached[:, numbers].any(1))
        for i in range(0, len(asking), QUERY_BLOCK):
            who = asking[i : i + QUERY_BLOCK]
            score = np.full((len(who), keep + len(lists)), -np.inf)
            score[:, :keep] = self.near[who]
            for number, a, b in zip(numbers, starts, ends):
                rows = np.flatnonzero(self.reached[who, number])
                score[rows, keep + a : keep + b] = self.x[who[rows]] @ vectors[a:b].T
            best = np.argpartition(score, len(lists), axis=1)[:, len(lists) :]
            before = np.take_along_axis(self.head[who], np.minimum(best, keep - 1), 1)
            self.head[who] = np.where(best < keep, before, heads[np.maximum(best - keep, 0)])
            self.near[who] = np.take_along_axis(score, best, 1)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query (its place), head and score of all that was kept."""
        for a in range(0, len(self.x), QUERY_BLOCK):
            near = self.near[a : a + QUERY_BLOCK]
            who, at = np.nonzero(near > -np.inf)
            if len(who):
                yield who + a, self.head[a : a + QUERY_BLOCK][who, at], near[who, at]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<double>, all of the longest length) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    ends = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if ends[0] == ends[1]:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(ends[1]) - F.size("v"))))


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every row for which ``is_query(id)`` holds."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")
    rows = scratch.save(usable(vectors, key, vector), "rows")
    marked = rows.withColumns({"e1": F.xxhash64("v"), "e2": F.xxhash64(F.lit(1), "v")})
    copies = scratch.save(marked.dropDuplicates(["id", "e1", "e2"]).withColumn("r", F.row_number().over(Window.partitionBy("e1", "e2").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "e1", "e2", "r", "v"), "copies")
    heads = copies.where("r = 1").select(F.col("id").alias("head"), "v")
    total = heads.count()
    id_type = dict(rows.dtypes)["id"]
    if not total:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    share = F.pmod(F.xxhash64("head"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = heads.where(share * total < TRAIN_ROWS).toArrow()
    if not len(got):
        got = heads.limit(1).toArrow()
    own, first = np.unique(got.column("head").to_numpy(), return_index=True)
    sample = got.column("v").combine_chunks().flatten().to_numpy().reshape(len(got), -1)
    shared = spark.sparkContext.broadcast((fit(sample.astype(np.float32), total), sample[first][: FLOOR_BYTES // (8 * sample.shape[1])]))
    of_one_id = 1 if len(own) == len(got) == total else heads.groupBy("head").count().agg(F.max("count")).first()[0]
    keep = max(RERANK, k + (k + 1) * of_one_id)
    kind = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64  # as given: nothing is lost
    at_once = max(1, PACK_BYTES // (np.dtype(kind).itemsize * sample.shape[1]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value[0]
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            lists = nearest(x.astype(np.float32), q.centroids)
            away = x - q.centroids[lists]
            yield pa.RecordBatch.from_arrays([batch.column("head"), pa.array(lists.astype(np.int32)), pa.array(np.sqrt((away * away).sum(1))), pa.array([c.tobytes() for c in x.astype(kind)], pa.binary())], ["head", "list", "away", "code"])

    indexed = scratch.save(heads.mapInArrow(index, f"head {id_type}, list int, away double, code binary"), "index")
    sizes, radii = np.zeros(len(shared.value[0].centroids), np.int64), np.full(len(shared.value[0].centroids), -1.0)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():  # one row per list: at most LISTS_MOST
        sizes[r["list"]], radii[r["list"]] = r["n"], r["away"]
    asked = scratch.save(rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), "queries")
    sheets = max(1, -(-asked.count() // QUERY_BLOCK))
    cells = max(CELLS, 2 * spark.sparkContext.defaultParallelism)
    slices = max(-(-sheets // max(1, SHEETS_AT_ONCE * RERANK // keep)), min(sheets, int(SLICES_OF_ROOT * cells**0.5)))
    parts = min(-(-total // BLOCK), -(-cells // slices))
    starts = np.cumsum(sizes) - sizes
    # lists x parts: whether the part holds vectors of the list
    holds = (np.arange(parts) >= (starts * parts // total)[:, None]) & (np.arange(parts) <= ((starts + sizes - 1) * parts // total)[:, None])
    at = F.element_at(F.lit(starts.tolist()), F.col("list") + 1) + F.pmod(F.xxhash64("head"), F.element_at(F.lit(sizes.tolist()), F.col("list") + 1))
    packs = indexed.withColumn("at", at).withColumns({"part": F.expr(f"int(at * {parts} div {total})"), "pack": F.expr(f"at div {at_once}")})
    packs = packs.groupBy("part", "list", "pack").agg(F.sort_array(F.collect_list(F.struct("head", "code"))).alias("m"))
    packs = packs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, of = shared.value
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            floors = q.floors(x, of, k)
            who, number = np.nonzero(q.reached(x, floors, radii).astype(np.float32) @ holds.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(who)), pa.array(number.astype(np.int32)), batch.column("v").take(pa.array(who)), pa.array(floors[who])], ["query_id", "part", "v", "floor"])

    probes = asked.mapInArrow(probe, f"query_id {id_type}, part int, v array<double>, floor double").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))
    cell = (F.col("slice") * parts + F.col("part")).cast("int").alias("cell")
    nothing = {c: F.lit(None).cast(dict(packs.dtypes)[c]).alias(c) for c in ("pack", "m")}
    queries = probes.select(cell, F.lit(-1).alias("list"), nothing["pack"], "query_id", "v", "floor", nothing["m"])  # before all vectors of their cell
    codes = packs.select(cell, "list", "pack", F.lit(None).cast(id_type).alias("query_id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("floor"), "m")
    dealt = queries.union(codes).repartitionById(slices * parts, "cell").sortWithinPartitions("cell", "list", "pack", "query_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, cell, asking, best = shared.value[0], None, [], None

        def result() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([b.column("query_id") for b in asking])
            for who, head, near in best.found():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(head, ids.type), pa.array(near)], ["query_id", "head", "near"])

        for batch in batches:
            cells, lists = batch.column("cell").to_numpy(), batch.column("list").to_numpy()
            cuts = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if cells[a] != cell:
                    if best:
                        yield from result()
                    cell, asking, best = cells[a], [], None
                n = a + int(np.searchsorted(lists[a:b], 0))
                if n > a:
                    asking.append(batch.slice(a, n - a))
                if n == b or not asking:
                    continue
                if not best:
                    x = np.concatenate([g.column("v").flatten().to_numpy().reshape(g.num_rows, -1) for g in asking])
                    best = Best(x, q.reached(x, np.concatenate([g.column("floor").to_numpy() for g in asking]), radii), keep)
                m = batch.column("m").slice(n, b - n)
                held, of = m.flatten(), np.repeat(lists[n:b], m.value_lengths().to_numpy())
                code, heads_ = held.field("code"), held.field("head").to_numpy(zero_copy_only=False)
                for i in range(0, len(held), BLOCK):
                    block = np.frombuffer(b"".join(code[i : i + BLOCK].to_pylist()), kind).reshape(-1, x.shape[1])
                    best.meet(of[i : i + BLOCK], block.astype(np.float64), heads_[i : i + BLOCK])
        if best:
            yield from result()

    found = dealt.mapInArrow(scan, f"query_id {id_type}, head {id_type}, near double")
    line = Window.partitionBy("query_id").orderBy(F.desc("near"), "head")
    best = found.withColumn("r", F.row_number().over(line)).where(F.col("r") <= keep).select("query_id", "head")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = best.join(heads, "head").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id").select("query_id", "head", product.alias("score"))
    of = copies.select("id", "e1", "e2").join(copies.where("r = 1").select(F.col("id").alias("head"), "e1", "e2"), ["e1", "e2"]).select("head", F.col("id").alias("vec_id"))
    ranked = scored.join(of, "head").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
