"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on full sets.

Documents with equal shingle sets are one node. A node's signature is read in several orders,
one per tree; within a tree, nodes sorted by their order meet in regions that share a prefix
of ``DEPTH`` values. In the first pass the depth adapts to the region: one with more than
``CROWDED`` nodes is split by prefixes of 8 and then 12 values, and what is crowded still is cut
into parts of about ``PART`` nodes; a node's candidates are its neighbours in the sorted order of
its region, those that share most trees first, then those with the longest common prefix.
Confirmed links give components. The second pass completes what depth and cuts left out: in every
region of ``DEPTH`` that still holds more than one component, members of different components are
compared in blocks, first by signatures, then (those that are near) by their whole sets, and the
links between components come out as spanning forests. A component that fills blocks of its own
never meets itself. So no candidate is dropped for the size of a region, no region is expanded
into all pairs, and no task holds more than two blocks.

A pair at the threshold shares no region with probability (1 - s**DEPTH)**TREES: 2e-8 at 0.85.
Pairs whose signatures agree in less than the threshold minus five standard errors are not
confirmed. Confirmation is exact: the distinct shingles of both texts are intersected.

Cases: null text, empty text, no words -> empty set, linked with nothing, own component; fewer
words than a shingle -> the whole sequence is the one shingle; a null id never becomes a
component's id unless all are null; repeated rows are one node; ties go to the smaller id; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.arrowtext import chunks, encode_words, mix64, owners
from webloom.llm.graph import connected_components
from webloom.session import Scratch

TREES, DEPTH = 24, 4
VALUES = TREES * DEPTH
#: Neighbours of a node that the first pass confirms.
FIRST_NEIGHBOURS = 2
#: Nodes of a region beyond which the first pass looks at longer prefixes, and of the parts of regions that stay crowded.
CROWDED, PART = 64, 2_048
#: Members of a region compared at once, by signatures and by whole sets.
BLOCK, SET_BLOCK = 256, 64
#: Node lists up to this many rows may be broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240)
_MULTIPLY = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, sorted within the text, and offsets."""
    words = encode_words(texts, lower_ascii=True)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter((digest(w) for w in words.vocab.to_pylist()), np.uint64, len(words.vocab))[words.codes]
    n = len(hashed)
    rolled = np.full(n, width, np.uint64)
    for j in range(width):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - j)] = hashed[j:]
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + part
    start, count = words.offsets[:-1], words.counts
    keep = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(count >= width)
    np.add.at(keep, start[long], 1)
    np.add.at(keep, start[long] + count[long] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
    doc, value = owners(words.offsets)[at], mix64(rolled[at])
    for i in np.flatnonzero((count > 0) & (count < width)):  # the whole sequence as one
        h = np.uint64(count[i])
        for w in hashed[start[i] : start[i] + count[i]]:
            h = np.uint64((int(h) * 0x9E3779B97F4A7C15 + int(w)) & 0xFFFFFFFFFFFFFFFF)
        doc, value = np.append(doc, i), np.append(value, mix64(np.array([h], np.uint64)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[fresh], value[fresh]
    return value, np.searchsorted(doc, np.arange(len(start) + 1))


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """VALUES minima per text (texts without shingles: all ones)."""
    out = np.full((len(offsets) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat(((value * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), offsets[:-1][full])
    return out


def _tree_keys(sig: np.ndarray) -> np.ndarray:
    """One hash of the first DEPTH values for every tree."""
    keys = np.empty((len(sig), TREES), np.uint64)
    for t in range(TREES):
        h = np.full(len(sig), t + 1, np.uint64)
        for j in range(DEPTH):
            h = mix64(h + np.uint64(0x9E3779B97F4A7C15) + sig[:, t * DEPTH + j].astype(np.uint64))
        keys[:, t] = h
    return keys.view(np.int64)


def scan(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n, d1, d2 (digests of the set), keys and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=4_000_000):
            value, offsets = shingles(batch.column("text"), width)
            sig, n = signatures(value, offsets), np.diff(offsets)
            with_sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
            full = np.flatnonzero(n)
            for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                if len(full):
                    with_sums[i][full] = np.add.reduceat(mix64(value ^ np.uint64(salt)), offsets[:-1][full])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * TREES + 1, TREES, dtype=np.int32)), pa.array(_tree_keys(sig).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in with_sums), keys, pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "t1", "t2", "n", "d1", "d2", "keys", "sig"])

    picked = docs.select(F.col(key).alias("doc_id"), *text_hashes(F.col(text)), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, t1 bigint, t2 bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, sig binary")


def text_hashes(text):
    return F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(7)).alias("t2")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets overlap by ``percent`` or more; texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for mid in chunks(iter([whole]), "text_a", 3_000_000):
                for batch in chunks(iter([mid]), "text_b", 3_000_000):
                    left, lo = shingles(batch.column("text_a"), width)
                    right, ro = shingles(batch.column("text_b"), width)
                    pair, value = np.concatenate([owners(lo), owners(ro)]), np.concatenate([left, right])
                    order = np.lexsort((value, pair))
                    pair, value = pair[order], value[order]
                    same = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=batch.num_rows)
                    union = np.diff(lo) + np.diff(ro) - same
                    keep = pa.array((100 * same >= percent * union) & (union > 0))
                    yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _neighbours(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """The first pass's pairs: per node the neighbours in sorted orders that share most.

    ``members`` has ``c``, the size of the region of depth DEPTH.
    """
    order = F.concat(*(F.substring("sig", F.pmod(F.col("tree") * (4 * DEPTH) + F.lit(16 * i), F.lit(4 * VALUES)) + 1, F.lit(16)) for i in range(3)))
    placed = members.join(sigs.select("node", "n", "sig"), "node").select("key", "c", "node", "n", order.alias("order"))
    calm = placed.where(F.col("c") <= CROWDED).withColumn("region", F.col("key"))
    busy = placed.where(F.col("c") > CROWDED).withColumn("deep", F.xxhash64("key", F.substring("order", 1, 32)))
    busy = busy.join(busy.groupBy("deep").agg(F.count(F.lit(1)).alias("c8")), "deep")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("c8") / PART))
    busy = busy.withColumn("region", F.when(F.col("c8") <= CROWDED, F.col("deep")).otherwise(F.xxhash64("deep", "order", part)))
    line = Window.partitionBy("region").orderBy("order", "n", "node")
    near = calm.unionByName(busy.select(*calm.columns)).select("node", "order", F.lag("node").over(line).alias("other"), F.lag("order").over(line).alias("other_order")).where("other is not null")
    prefix = sum((F.when(F.substring("order", 1, 4 * i) == F.substring("other_order", 1, 4 * i), 1).otherwise(0) for i in range(DEPTH + 1, 13)), F.lit(0))
    near = near.groupBy("node", "other").agg(F.count(F.lit(1)).alias("shared"), F.max(prefix).alias("depth"))
    best = Window.partitionBy("node").orderBy(F.desc("shared"), F.desc("depth"), "other")
    return near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= FIRST_NEIGHBOURS).select(F.col("node").alias("a"), F.col("other").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _met(rows: DataFrame, size: int, wide: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """key, tree, m1, m2: pairs of blocks of about ``size`` members of one region, with the columns of ``wide`` (by node).

    A component with ``size`` members or more fills blocks of its own (its entry), which do not meet
    each other; the members of all smaller ones share the blocks of entry -1. Blocks are numbered by
    hashes and meet by their numbers, so a crowded region is many pieces of work.
    """
    rows = scratch.save(rows.select("key", "tree", "node", "component"), f"{name}-rows")
    per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("entry", F.when(F.col("n") >= size, F.col("component")).otherwise(F.lit(-1)))
    entries = per.groupBy("key", "entry").agg(F.ceil(F.sum("n") / size).cast("int").alias("parts"))
    entries = scratch.save(entries, f"{name}-entries")
    own = rows.join(per.select("key", "component", "entry"), ["key", "component"]).join(entries, ["key", "entry"])
    own = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    fields = [c for c in wide.columns if c != "node"]
    blocks = own.join(wide, "node").groupBy("key", "entry", "part").agg(F.min("tree").alias("tree"), F.collect_list(F.struct("node", "component", *fields)).alias("m"))
    blocks = scratch.save(blocks, f"{name}-blocks")
    alone = blocks.where("entry = -1").select("key", "tree", F.col("m").alias("m1"), F.col("m").alias("m2"))
    left = entries.select("key", F.col("entry").alias("e1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p1"))
    right = entries.select("key", F.col("entry").alias("e2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p2"))
    pairs = left.join(right, "key").where("e1 < e2 or e1 = -1 and e2 = -1 and p1 < p2")
    first = blocks.select("key", "tree", F.col("entry").alias("e1"), F.col("part").alias("p1"), F.col("m").alias("m1"))
    second = blocks.select("key", F.col("entry").alias("e2"), F.col("part").alias("p2"), F.col("m").alias("m2"))
    return alone.unionByName(pairs.join(first, ["key", "e1", "p1"]).join(second, ["key", "e2", "p2"]).select("key", "tree", "m1", "m2"))


def _near(members: DataFrame, sigs: DataFrame, component: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """key, tree, node of the members of a region whose signature is near one of another component there.

    A pair counts in the first tree that it shares, so it is looked at once. Only members come
    out, at most one row for each block met, never the pairs.
    """
    sized = members.select("key", "tree", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = sized.groupBy("key").agg((F.min("component") != F.max("component")).alias("open")).where("open").select("key")
    met = _met(sized.join(several, "key", "left_semi"), BLOCK, sigs.select("node", "n", "sig"), scratch, "near")
    s = percent / 100
    least = int(np.floor(VALUES * (s - 5 * np.sqrt(s * (1 - s) / VALUES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fields(column, i):
            x = column[i].values
            sig = np.frombuffer(b"".join(x.field("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
            return x.field("node").to_numpy(), x.field("component").to_numpy(), x.field("n").to_numpy(), sig

        for batch in batches:
            for i in range(batch.num_rows):
                key, tree = batch.column("key")[i].as_py(), batch.column("tree")[i].as_py()
                a, ca, na, sa = fields(batch.column("m1"), i)
                b, cb, nb, sb = fields(batch.column("m2"), i)
                agree, earlier = np.zeros((len(a), len(b)), np.int16), np.zeros((len(a), len(b)), bool)
                for t in range(TREES):
                    whole = np.ones_like(earlier)
                    for k in range(t * DEPTH, (t + 1) * DEPTH):
                        same = sa[:, k, None] == sb[None, :, k]
                        agree += same
                        whole &= same
                    if t < tree:
                        earlier |= whole
                ok = (agree >= least) & ~earlier & (ca[:, None] != cb[None, :]) & (100 * np.minimum.outer(na, nb) >= percent * np.maximum.outer(na, nb))
                nodes = np.union1d(a[ok.any(1)], b[ok.any(0)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), key)), pa.array(np.full(len(nodes), tree, np.int32)), pa.array(nodes)], ["key", "tree", "node"])

    return met.mapInArrow(run, "key bigint, tree int, node bigint").distinct()


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """node, shingles (sorted hashes) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=4_000_000):
            value, offsets = shingles(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.view(np.int64)))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def overlaps(left: np.ndarray, lo: np.ndarray, right: np.ndarray, ro: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by matrix products."""
    shared = np.intersect1d(left, right)
    out = np.zeros((len(lo) - 1, len(ro) - 1), np.float32)
    for a in range(0, len(shared), 2_048):
        part = shared[a : a + 2_048]
        ends = []
        for value, offsets in ((left, lo), (right, ro)):
            place = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = np.flatnonzero(part[place] == value)
            m = np.zeros((len(offsets) - 1, len(part)), np.float32)
            m[owners(offsets)[hit], place[hit]] = 1
            ends.append(m)
        out += ends[0] @ ends[1].T
    return out.astype(np.int64)


def _across(near: DataFrame, component: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b: component ids) between components with members of one region that overlap enough.

    Every pair of members of different components is decided exactly; of the links between the
    components of two blocks, a spanning forest comes out.
    """
    rows = near.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    met = _met(rows, SET_BLOCK, sets, scratch, "across")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fields(column, i):
            x = column[i].values
            lists = x.field("shingles")
            return x.field("component").to_numpy(), lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.array([len(v) for v in lists]))]).astype(np.int64)

        for batch in batches:
            for i in range(batch.num_rows):
                ca, left, lo = fields(batch.column("m1"), i)
                cb, right, ro = fields(batch.column("m2"), i)
                same = overlaps(left, lo, right, ro)
                union = np.add.outer(np.diff(lo), np.diff(ro)) - same
                x, y = np.nonzero((100 * same >= percent * union) & (ca[:, None] != cb[None, :]))
                root: dict[int, int] = {}

                def top(c, root=root):
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                links = []
                for p, q in np.unique(np.column_stack([ca[x], cb[y]]), axis=0).tolist():
                    p, q = sorted((top(p), top(q)))
                    if p != q:
                        root[q] = p
                        links.append((p, q))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in links], pa.int64()), pa.array([q for _, q in links], pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _merge(component: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components after further links between them (a, b: component ids)."""
    more = connected_components(links, scratch, name).select(F.col("node").alias("component"), F.col("component").alias("to"))
    joined = component.join(more, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = more.join(component.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return scratch.save(joined.unionByName(alone), f"{name}-components")


def components(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id, rid (a number of the row) and component of every row.

    ``component`` tells groups apart (the ``rid`` of one of their rows); ``component_id`` is only
    their smallest id: null where no member has one, and shared by groups with the same id.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "neardup")
    rows = scratch.save(scan(docs, width, key, text).withColumn("rid", F.monotonically_increasing_id()), "rows")
    nodes = scratch.save(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")), "nodes")
    heads = rows.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "node")
    entries = heads.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = scratch.save(entries.join(shared, "key"), "members")
    wanted = members.select("node").distinct()
    sigs = scratch.save(heads.join(wanted, "node", "left_semi").select("node", "doc_id", "t1", "t2", "n", "sig"), "signatures")
    marks = sigs.select("node", F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    if sigs.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    found = docs.select(F.col(key).alias("doc_id"), *text_hashes(F.col(text)), F.col(text).alias("text")).join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")))
    repeated = rows.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    texts = scratch.save(found.select("node", "text").dropDuplicates(["node"]) if repeated else found.select("node", "text"), "texts")

    links = scratch.save(confirmed(_neighbours(members, sigs), texts, width, percent), "links-1")
    component = scratch.save(connected_components(links, scratch, "first"), "components-1")
    near = scratch.save(_near(members, sigs, component, percent, scratch), "near")
    sets = scratch.save(_sets(texts.join(near.select("node").distinct(), "node", "left_semi"), width), "sets")
    links = scratch.save(_across(near, component, sets, percent, scratch), "links-2")
    component = _merge(component, links, scratch, "second")
    scratch.drop("texts", "members", "signatures", "near", "sets", *(f"{a}-{b}" for a in ("near", "across") for b in ("rows", "entries", "blocks")))

    named = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("n", "d1", "d2", "component", "component_id")
    out = rows.select("rid", "doc_id", "t1", "t2", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("rid", F.col("doc_id"), "t1", "t2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "rid").alias("component"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group (the smallest id); empty texts all stay."""
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.save(components(docs, width, percent, key, text), "components")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("component"), F.max("n_shingles").alias("n"))
    # rows of one id with different texts in one group: the first text stays
    one = Window.partitionBy("component").orderBy("t1", "t2")
    stay = stay.withColumn("r", F.row_number().over(one)).where("r = 1")
    h1, h2 = text_hashes(F.col(text))
    marked = docs.withColumns({"__t1": h1, "__t2": h2})
    marks = stay.select(F.col("doc_id").alias("__id"), F.col("t1").alias("__s1"), F.col("t2").alias("__s2"), ((F.col("c") > 1) & (F.col("n") > 0)).alias("__more"))
    kept = marked.join(marks, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__t1") == F.col("__s1")) & (F.col("__t2") == F.col("__s2")))
    single = kept.where(~F.col("__more"))
    again = kept.where("__more").dropDuplicates(["__t1", "__t2", key])
    return single.unionByName(again).select(*(F.col(f"`{c}`") for c in docs.columns))
