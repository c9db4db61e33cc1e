"""Connected components of a link table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import Scratch


#: Links that one task contracts in memory (a few tens of MB).
LOCAL_LINKS = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around their smallest nodes."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not got:
        return
    nodes, ends = np.unique(np.concatenate([*(u for u, _ in got), *(v for _, v in got)]), return_inverse=True)
    u, v = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        if (root[u] == root[v]).all():
            break
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node that has a link to another.

    ``links`` has columns a and b (64-bit integers). First every partition of at most LOCAL_LINKS links contracts
    them to stars; a table of one such partition is done then. Otherwise large-star and
    small-star steps alternate: the number of rounds grows with the logarithm of a component's
    size, also for chains, and a node's neighbours are only ever reduced to their minimum,
    never gathered. Each round is a written table, so lineage stays short and a lost executor
    costs one round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.save(edges, f"{name}-0")
    parts = max(1, -(-edges.count() // LOCAL_LINKS))
    edges = scratch.save(edges.repartition(parts).mapInArrow(_contract, "u bigint, v bigint"), f"{name}-stars")
    scratch.drop(f"{name}-0")
    state, last = _state(edges) if parts > 1 else None, f"{name}-stars"
    for turn in range(1, most_rounds + 1):
        if parts == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"{name}-{turn}")
        scratch.drop(last)
        last, before, state = f"{name}-{turn}", state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
