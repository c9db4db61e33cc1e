"""Exact repeated passages through a log-structured index of window fingerprints.

Every run of ``WINDOW`` words has a 64-bit fingerprint; documents are taken in batches by id. The
index is a list of immutable runs, each a table bucketed and sorted by the fingerprint, with the
first place of every fingerprint. A batch is dealt out by the fingerprint and merge-joined with
the runs without moving them; windows that start earlier in a run or in the batch are covered by
the first place. New fingerprints become a run, and runs are compacted when there are ``FAN_IN``.

Then the words are verified: covered windows that follow each other in both documents form a
stretch, and the SHA-256 of its words must be that of the words at the first place, read from the
document there. Equal words have equal fingerprints, so nothing is lost; if different words should
share one, all is done again with another seed.

Without an index of its own a call needs only windows that may repeat: each window has an anchor,
the least hash of its ``GRAM``-word stretches (the leftmost, if equal). Equal windows have equal
anchors at equal offsets, so a window whose anchor occurs at one place only is unique. Anchors are
counted over all documents; the repeated ones are broadcast to the scan while there are at most
``BROADCAST_ANCHORS`` of them (8 MB) and are met by a shuffled semi-join beyond. A lasting index
(``FingerprintIndex.open``) takes every window, so documents of later days meet all earlier ones.

Cases: null or empty texts have no words and keep the empty text; fewer words than a window:
nothing is covered; repeated rows (one id, one text) are one document and get one result each;
a null id counts as the smallest; equal starts in rows of one id do not cover each other; ids that
are no numbers are one batch; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from webloom.llm.arrowtext import chunks, encode_words, mix64, raw, split_words
from webloom.session import Scratch

WINDOW = 20
GRAM = 8
BATCHES = 3
FAN_IN = 3
BROADCAST_ANCHORS = 2_000_000
#: Ids of source documents that are broadcast for the verification (8 bytes each).
BROADCAST_SOURCES = 1_000_000
#: Seeds that are tried before giving up; one is enough unless 64-bit hashes collide.
SEEDS = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _roll(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Mixed polynomial of every ``k`` neighbours, put together from spans of doubled length."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    span, part, power = 1, h, int(base)
    done, r = 0, h[:0]
    while True:
        if k & span:
            m = len(h) - done - span + 1
            r = part if done == 0 else r[:m] * np.uint64(power) + part[done : done + m]
            done += span
        if done == k:
            return mix64(r)
        m = len(part) - span
        part = part[:m] * np.uint64(power) + part[span : span + m]
        power, span = power * power % (1 << 64), 2 * span


def _least(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``k`` neighbours and its (leftmost) place, by spans of doubled length."""
    low, place = values, np.arange(len(values))
    if len(values) < k:
        return low[:0], place[:0]
    span = 1
    while span < k:
        step = min(span, k - span)
        right, left = low[step:], low[:-step]
        place = np.where(right < left, place[step:], place[:-step])
        low = np.minimum(left, right)
        span += step
    return low, place


def _windows(texts: pa.Array, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row, fingerprint, anchor hash and anchor place of every window."""
    gram = min(GRAM, window)
    words = encode_words(texts)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter((digest(w, seed) for w in words.vocab.to_pylist()), np.uint64, len(words.vocab))[words.codes]
    m = max(0, len(hashed) - window + 1)
    row = np.repeat(np.arange(len(words.offsets) - 1), words.counts)[:m]
    at = np.flatnonzero(np.arange(m) + window <= words.offsets[1:][row])
    low, place = _least(_roll(hashed, gram, _BASE), window - gram + 1)
    return row[at], at - words.offsets[:-1][row[at]], _roll(hashed, window, _BASE)[at].view(np.int64), low[at].view(np.int64), place[at]


def repeated_anchors(docs: DataFrame, text: str = "text", window: int = WINDOW, seed: int = 0) -> DataFrame:
    """anchor hashes that stand at more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=6_000_000):
            _, _, _, anchor, place = _windows(batch.column("text"), window, seed)
            _, once = np.unique(place, return_index=True)
            value, n = np.unique(anchor[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["anchor", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


@dataclass
class Anchors:
    """The repeated anchors: in the workers' hands while they are few, a table otherwise."""

    table: DataFrame
    few: object | None  # broadcast of the sorted upper halves; a wrong match only adds a candidate


def share_anchors(anchors: DataFrame) -> Anchors:
    if anchors.count() > BROADCAST_ANCHORS:
        return Anchors(anchors, None)
    upper = anchors.select(F.shiftright("anchor", 32).cast("int").alias("a")).distinct().toArrow().column("a")
    return Anchors(anchors, anchors.sparkSession.sparkContext.broadcast(np.sort(upper.to_numpy().astype(np.int32))))


def _rows(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, one: np.ndarray) -> Iterator[pa.RecordBatch]:
    of = pa.array(row)
    for a in range(0, len(row), 200_000):
        part = slice(a, a + 200_000)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of[part]), batch.column("t").take(of[part]), pa.array(start[part].astype(np.int32)), pa.array(one[part])], ["doc_id", "t", "start", "h1"])


def candidate_windows(docs: DataFrame, anchors: Anchors | None, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = 0, mark: Column | None = None) -> DataFrame:
    """doc_id, t (``mark``, by default a hash of the text), start, h1 of the windows whose anchor is repeated (without ``anchors``: of all)."""
    picked = docs.select(F.col(key).alias("doc_id"), (F.xxhash64(text) if mark is None else mark).alias("t"), F.col(text).alias("text"))
    kind = dict(picked.dtypes)["doc_id"]
    schema = f"doc_id {kind}, t bigint, start int, h1 bigint"
    if anchors is None or anchors.few is not None:
        known = anchors.few if anchors else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = known.value if known else None
            for batch in chunks(batches, limit=6_000_000):
                row, start, one, anchor, _ = _windows(batch.column("text"), window, seed)
                if table is not None:
                    upper = (anchor >> 32).astype(np.int32)
                    hit = np.flatnonzero(table[np.minimum(np.searchsorted(table, upper), len(table) - 1)] == upper) if len(table) else np.zeros(0, np.int64)
                    row, start, one = row[hit], start[hit], one[hit]
                yield from _rows(batch, row, start, one)

        return picked.mapInArrow(run, schema)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=6_000_000):
            row, start, _, anchor, place = _windows(batch.column("text"), window, seed)
            _, once = np.unique(place, return_index=True)
            of = pa.array(row[once])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("t").take(of), pa.array((place[once] - _text_starts(batch)[row[once]]).astype(np.int32)), pa.array(anchor[once])], ["doc_id", "t", "place", "anchor"])

    found = picked.mapInArrow(places, f"doc_id {kind}, t bigint, place int, anchor bigint").join(anchors.table, "anchor", "left_semi")
    found = found.groupBy("doc_id", "t").agg(F.collect_set("place").alias("places")).withColumnsRenamed({"doc_id": "__id", "t": "__t"})
    met = picked.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))).select("doc_id", "t", "text", "places")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=6_000_000):
            row, start, one, _, place = _windows(batch.column("text"), window, seed)
            lists = batch.column("places")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            wanted = lists.flatten().to_numpy() + np.repeat(_text_starts(batch), size)
            hit = np.flatnonzero(np.isin(place, wanted))
            yield from _rows(batch, row[hit], start[hit], one[hit])

    return met.mapInArrow(expand, schema)


def _text_starts(batch: pa.RecordBatch) -> np.ndarray:
    """The index of each text's first word among the words of the block."""
    return split_words(batch.column("text"))[1][:-1]


class FingerprintIndex:
    """First places of all window fingerprints seen so far, in sorted immutable runs.

    ``open`` keeps an index in a folder that driver and executors share: its list of runs is
    written after every change, and a later session goes on from there.
    """

    def __init__(self, scratch: Scratch, fan_in: int = FAN_IN, folder: str | None = None, seed: int = 0):
        self.scratch, self.spark, self.fan_in, self.folder, self.seed = scratch, scratch.spark, fan_in, folder, seed
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fan_in: int = FAN_IN) -> FingerprintIndex:
        """The index in ``folder``, which is empty where the folder has none."""
        scratch = Scratch(spark, "fingerprints")
        scratch.root = folder
        index = cls(scratch, fan_in, folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/lists")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [p.getPath() for p in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(p.getName().partition("-")[2]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if done:
            index.version = max(done)
            rows = spark.read.parquet(f"{folder}/lists/v-{index.version}").orderBy("place").collect()  # one row per run
            index.parts, index.seed = rows[0]["parts"], rows[0]["seed"]
            for r in rows:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} (h1 BIGINT, doc_id {r['kind']}, start INT) USING parquet CLUSTERED BY (h1) SORTED BY (h1) INTO {r['parts']} BUCKETS LOCATION '{scratch.path(r['name'])}'")
                index.runs.append(r["name"])
        return index

    def _list(self) -> None:
        if self.folder:
            self.version += 1
            kind = dict(self.spark.table(self.runs[0]).dtypes)["doc_id"]
            rows = [(i, r, self.parts, self.seed, kind) for i, r in enumerate(self.runs)]
            self.spark.createDataFrame(rows, "place int, name string, parts int, seed int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/v-{self.version}")

    def _write_run(self, rows: DataFrame) -> str:
        """One table of ``rows`` (h1, doc_id, start); rows of one fingerprint are alike."""
        name = f"webloom_run_{uuid.uuid4().hex}"
        dealt = rows.select("h1", "doc_id", "start").repartition(self.parts, "h1").dropDuplicates(["h1"])
        dealt.write.bucketBy(self.parts, "h1").sortBy("h1").option("path", self.scratch.path(name)).format("parquet").saveAsTable(name)
        return name

    def ingest(self, batch: DataFrame, name: str, last: bool = False) -> DataFrame:
        """Covered windows (doc_id, t, start, source: the first place) of ``batch`` (doc_id, t, start, h1).

        The new fingerprints join the index, unless it is not asked again (``last``).
        """
        place = F.struct("doc_id", "start")
        dealt = batch.repartition(self.parts, "h1").withColumn("first", F.min(place).over(Window.partitionBy("h1")))
        for i, run in enumerate(self.runs):
            old = self.spark.table(run).select("h1", F.struct("doc_id", "start").alias(f"old{i}"))
            dealt = dealt.join(old, "h1", "left")
        olds = [F.col(f"old{i}") for i in range(len(self.runs))]
        known = F.coalesce(*olds).isNotNull() if olds else F.lit(False)
        # places in runs are of earlier batches; a later delivery of earlier ids is compared by place
        source = F.array_min(F.array("first", *olds)) if olds else F.col("first")
        covered = place > source
        new = F.lit(False) if last else ~covered & ~known
        out = dealt.select("doc_id", "t", "start", covered.alias("covered"), F.when(covered, source).alias("source"), F.when(new, F.col("h1")).alias("h1"), new.alias("new"))
        out.where("covered or new").write.mode("overwrite").partitionBy("new").parquet(self.scratch.path(name))
        out = self.scratch.load(name, out.schema)
        if not last:
            self.runs.append(self._write_run(out.where("new")))
            self.scratch.drop(f"{name}/new=true")  # what follows reads the covered windows alone
            if len(self.runs) >= self.fan_in:
                self.compact()
            self._list()
        return out.where("not new and covered").select("doc_id", "t", "start", "source")

    def compact(self) -> None:
        """Merge all runs into one; fingerprints of runs are disjoint."""
        merged = None
        for run in self.runs:
            part = self.spark.table(run)
            merged = part if merged is None else merged.unionByName(part)
        old, self.runs = self.runs, [self._write_run(merged)]
        if self.folder:
            self._list()  # before the old runs go, so that a stopped session finds whole ones
        self._forget(old)

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            self.scratch.drop(run)

    def close(self) -> None:
        """Drop the runs of an index that does not last."""
        if not self.folder:
            self._forget(self.runs)
            self.runs = []


def id_ranges(docs: DataFrame, key: str, batches: int) -> list:
    """Conditions that cut the rows into ranges of a numeric key, in order; nulls come first."""
    if batches < 2 or not isinstance(docs.schema[key].dataType, NumericType):
        return [F.lit(True)]
    quantiles = F.percentile_approx(F.col(key), F.array(*(F.lit((i + 1) / batches) for i in range(batches - 1))), F.lit(1000))
    cuts = [r[0] for r in docs.select(F.explode(quantiles)).distinct().orderBy("col").collect() if r[0] is not None]
    edges = [None, *cuts, None]
    out = []
    for a, b in zip(edges, edges[1:]):
        low = F.lit(True) if a is None else F.col(key) > F.lit(a)
        high = F.lit(True) if b is None else F.col(key) <= F.lit(b)
        out.append(F.coalesce(low & high, F.lit(a is None)))
    return out


def _stretches(row: np.ndarray, start: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> np.ndarray:
    """Ends of the stretches of covered windows (sorted by row and start) that follow each other in both documents."""
    breaks = (np.diff(row) != 0) | (np.diff(start) != 1) | (np.diff(source) != 0) | (np.diff(source_start) != 1)
    return np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(row)]])


def _digest(data: memoryview, ends: np.ndarray, a: int, b: int) -> bytes:
    """SHA-256 of the words ``a`` to ``b``: of their bytes and of their lengths, which together are the words."""
    sha = hashlib.sha256(data[ends[a] : ends[b]])
    sha.update(np.diff(ends[a : b + 1]).astype(np.int64).tobytes())
    return sha.digest()


def _cut(joined: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The result of every row of doc_id, text and covers (start and source of its covered windows), and its stretches."""
    kind = dict(joined.dtypes)["doc_id"]
    id_type = to_arrow_type(joined.schema["doc_id"].dataType)
    stretch_type = pa.list_(pa.struct([("doc_id", id_type), ("start", pa.int32()), ("words", pa.int32()), ("sha", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, offsets = split_words(batch.column("text"))
            n = np.diff(offsets)
            lists = batch.column("covers")
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            covers = lists.flatten()
            start = covers.field("start").to_numpy(zero_copy_only=False)
            first = covers.field("source")
            ids = first.field("doc_id").dictionary_encode()
            order = np.lexsort((start, np.repeat(np.arange(len(n)), length)))
            row, start = np.repeat(np.arange(len(n)), length)[order], start[order].astype(np.int64)
            source, source_start = pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False)[order], first.field("start").to_numpy(zero_copy_only=False)[order]
            at = start + offsets[:-1][row]
            edge = np.bincount(at, minlength=len(flat) + 1) - np.bincount(at + window, minlength=len(flat) + 1)
            stay = np.cumsum(edge[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(stay)])[offsets]
            kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), flat.filter(pa.array(stay))).cast(pa.list_(flat.type)), " ")
            spelt, cut = raw(kept)
            sha = [hashlib.sha256(spelt[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
            data, spans = raw(flat)
            known, ends, found = ids.dictionary.to_pylist(), _stretches(row, start, source, source_start), [[] for _ in n]
            for a, b in zip(ends, ends[1:]):
                if b > a:
                    size = int(b - a) + window - 1
                    found[row[a]].append({"doc_id": known[source[a]] if source[a] >= 0 else None, "start": int(source_start[a]), "words": size, "sha": _digest(data, spans, int(at[a]), int(at[a]) + size)})
            text = kept if with_text else pa.nulls(len(n), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), text, pa.array(sha, pa.string()), pa.array(found, stretch_type)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "stretches"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string, stretches array<struct<doc_id:{kind},start:int,words:int,sha:binary>>")


def unverified(stretches: DataFrame, texts: DataFrame, scratch: Scratch) -> int:
    """How many distinct stretches (doc_id, start, words, sha) are not the words at their place in ``texts`` (doc_id, text).

    Only documents that are a source are read for it; their ids are broadcast while there are few.
    """
    wanted = scratch.save(stretches.distinct(), "stretches")
    ids = scratch.save(wanted.select(F.col("doc_id").alias("__id")).distinct(), "sources")
    if ids.count() <= BROADCAST_SOURCES:
        ids = F.broadcast(ids)
    sources = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    asked = wanted.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start", "words", "sha")).alias("asked"))
    joined = sources.join(asked, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, offsets = split_words(batch.column("text"))
            data, spans = raw(flat)
            row, start, words, sha = [], [], [], []
            for i, asked_ in enumerate(batch.column("asked").to_pylist()):
                for x in asked_:
                    a = int(offsets[i]) + x["start"]
                    if a + x["words"] <= offsets[i + 1] and _digest(data, spans, a, a + x["words"]) == x["sha"]:
                        row.append(i), start.append(x["start"]), words.append(x["words"]), sha.append(x["sha"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(words, pa.int32()), pa.array(sha, pa.binary())], ["doc_id", "start", "words", "sha"])

    kind = dict(texts.dtypes)["doc_id"]
    right = joined.mapInArrow(run, f"doc_id {kind}, start int, words int, sha binary").distinct()
    return wanted.count() - right.count()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256 of every row.

    With a lasting ``index``, windows of earlier documents count as earlier places; ``history`` has
    those documents, whose words are verified against. Without ``with_text``, kept is left out.
    """
    told = docs.groupBy(F.col(key)).agg((F.min(F.xxhash64(text)) != F.max(F.xxhash64(text))).alias("several"))
    # where no id has different texts, the id alone names a document, and its windows travel without a mark
    mark = F.xxhash64(text) if told.where("several").limit(1).count() else F.lit(0).cast("long")
    whole = docs.select(F.col(key).alias("doc_id"), mark.alias("t"), F.col(text).alias("text"))
    for seed in range(SEEDS) if index is None else (index.seed,):
        scratch, covered = Scratch(docs.sparkSession, "substring"), None
        anchors = share_anchors(scratch.save(repeated_anchors(docs, text, window, seed), "anchors")) if index is None else None
        own = FingerprintIndex(scratch) if index is None else index
        ranges = id_ranges(docs, key, batches)
        for i, rows in enumerate(ranges):
            name = f"batch-{i}" if index is None else f"batch-{uuid.uuid4().hex}"
            found = own.ingest(candidate_windows(docs.where(rows), anchors, key, text, window, seed, mark), name, index is None and i + 1 == len(ranges))
            covered = found if covered is None else covered.unionByName(found)
        starts = covered.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "source")).alias("covers"))
        joined = whole.alias("w").join(starts.alias("s"), F.col("w.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("w.t").eqNullSafe(F.col("s.t")), "left").select("w.doc_id", "w.text", "s.covers")
        out = scratch.save(_cut(joined, window, with_text), "result")
        own.close()
        texts = whole.select("doc_id", "text")
        if history is not None:
            texts = texts.unionByName(history.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
        wrong = unverified(out.select(F.explode("stretches").alias("s")).select("s.*"), texts, scratch)
        if not wrong:
            out = out.drop("stretches") if with_text else out.drop("stretches", "kept")
            return out.withColumnRenamed("doc_id", key) if key != "doc_id" else out
    raise RuntimeError(f"{wrong} stretches differ from the words at their first place: build the index with another seed")
