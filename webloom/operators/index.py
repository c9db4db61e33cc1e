"""The search index as written tables: postings by term bucket, live rows and field statistics.

``postings`` holds one row per term of a row and field, in folders by generation and hash bucket of
the term, so a query opens the buckets of its own terms and nothing is tokenised at query time. ``live``
holds one narrow row per indexed row: its keys, the generation of its postings, its attributes and
field lengths. A replaced row gets new postings under a new generation; the old ones stay
unreachable until ``compact``. Every task writes the postings of its own rows to the folders, in
order of their terms, so nothing is shuffled and a frequent term is no task's burden. Postings hold
the attributes and lengths of their row as of writing, so an index that was not changed since its
rebuild is read without ``live``. A count-only change rewrites ``live`` alone. A change first writes
its postings, then the next version of ``live``: readers see whole versions, and a writer that was
stopped in between repeats the change over what it left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import Scratch

BUCKETS = 64
#: Bytes of rows in a task that spells and sorts postings, read or shuffled; a row has many postings, and their sort should fit into memory.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in TASK_BYTES}
    try:
        for k, v in TASK_BYTES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tokens(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


class SearchIndex:
    """An index over rows with ``keys``, text ``fields`` and narrow ``attributes``."""

    def __init__(self, scratch: Scratch, name: str, keys: tuple[str, ...], fields: tuple[str, ...], attributes: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.scratch, self.name, self.keys, self.fields, self.attributes, self.buckets = scratch, name, keys, fields, attributes, buckets
        self.spark = scratch.spark

    # versions

    def version(self) -> int:
        """The last whole version, read from storage: -1 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.scratch.path(f"{self.name}/live"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return -1
        names = [s.getPath() for s in fs.listStatus(path)]
        return max((int(p.getName().partition("=")[2]) for p in names if p.getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=-1)

    def live(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.scratch.path(f"{self.name}/live/v={self.version() if version is None else version}"))

    def _commit(self, live: DataFrame, version: int) -> None:
        live.write.mode("overwrite").parquet(self.scratch.path(f"{self.name}/live/v={version}"))
        if version > 1:
            self.scratch.drop(f"{self.name}/live/v={version - 2}")

    # writing

    def _spelt(self, rows: DataFrame) -> DataFrame:
        """The postings of ``rows``, each row by itself: its words, sorted and cut where the word changes if one is repeated."""
        own = [*self.keys, *self.attributes]
        words = rows.select(*own, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in self.fields))).alias("x")).select(*own, "x.field", "x.words")
        repeated = F.size(F.array_distinct("words")) < F.size("words")
        told = words.where("size(words) > 0").withColumn("s", F.when(repeated, F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
        cut = told.withColumn("starts", F.expr("CASE WHEN s IS NOT NULL THEN filter(sequence(1, size(s)), i -> i = 1 OR element_at(s, i).w <> element_at(s, greatest(i - 1, 1)).w) END"))
        once = "transform(words, (w, i) -> struct(w AS term, array(i) AS positions))"  # most rows: no word twice
        runs = "transform(starts, (a, j) -> struct(element_at(s, a).w AS term, transform(slice(s, a, coalesce(get(starts, j + 1), size(s) + 1) - a), x -> x.i) AS positions))"
        spelt = cut.select(*own, "field", F.size("words").alias("dl"), F.explode_outer(F.expr(f"CASE WHEN s IS NULL THEN {once} ELSE {runs} END")).alias("x")).select(*own, "field", "dl", "x.term", "x.positions")
        return spelt.withColumn("bucket", self._bucket(F.col("term")))

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _rows(self, rows: DataFrame, gen: int) -> DataFrame:
        return rows.select(*self.keys, F.lit(gen).alias("gen"), *self.attributes, *(F.size(tokens(F.col(f))).alias(f"dl_{f}") for f in self.fields))

    def _store(self, spelt: DataFrame, gen: int) -> None:
        spelt.sortWithinPartitions("bucket", "term", *reversed(self.keys)).write.mode("overwrite").partitionBy("bucket").parquet(self.scratch.path(f"{self.name}/postings/gen={gen}"))

    def _postings(self) -> DataFrame:
        schema = self.live().select(*self.keys, *self.attributes).schema.simpleString()[len("struct<") : -1]
        return self.spark.read.schema(f"{schema.replace(':', ' ')}, field string, dl int, term string, positions array<int>, gen int, bucket int").parquet(self.scratch.path(f"{self.name}/postings"))

    def truncate(self) -> None:
        self.scratch.drop(self.name)

    def rebuild(self, rows: DataFrame) -> None:
        """The index of exactly ``rows``."""
        self.truncate()
        with small_tasks(self.spark):
            rows = self.scratch.save(rows.select(*self.keys, *self.attributes, *self.fields), f"{self.name}-rows")  # read twice, made once
            self._store(self._spelt(rows), 0)
            self._commit(self._rows(rows, 0), 0)
        self.scratch.drop(f"{self.name}-rows")

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None, counts: DataFrame | None = None, stays: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Replace ``rows`` whole, drop the keys of ``gone``, and set attributes of rows by ``counts`` (keys, attributes).

        ``stays`` tells which live rows are left beside ``rows``, where the caller knows that without comparing keys.
        """
        keys, version = list(self.keys), self.version()
        gen = version + 1
        with small_tasks(self.spark):
            rows = self.scratch.save(rows.select(*keys, *self.attributes, *self.fields), f"{self.name}-rows")
            before = self.live(version) if version >= 0 else self._rows(rows, gen).where("false")
            self._store(self._spelt(rows), gen)
        left = stays(before) if stays else before.join(rows.select(*keys).distinct(), keys, "left_anti")
        if gone is not None:
            left = left.join(gone.select(*keys).distinct(), keys, "left_anti")
        if counts is not None:
            new = counts.select(*keys, *(F.col(a).alias(f"new_{a}") for a in self.attributes if a in counts.columns), F.lit(True).alias("__set"))
            left = left.join(new, keys, "left")
            left = left.select(*keys, "gen", *(F.when(F.col("__set"), F.col(f"new_{a}")).otherwise(F.col(a)).alias(a) if a in counts.columns else F.col(a) for a in self.attributes), *(f"dl_{f}" for f in self.fields))
        self._commit(left.unionByName(self._rows(rows, gen)), gen)
        self.scratch.drop(f"{self.name}-rows")

    def compact(self) -> None:
        """Gather the reachable postings under one new generation and drop all others."""
        version = self.version()
        live, gen = self.live(version), version + 1
        kept = self._postings().join(live.select(*self.keys, "gen"), [*self.keys, "gen"], "left_semi")
        old = [r["gen"] for r in self._postings().select("gen").distinct().collect()]  # one row per change since the last time
        self._store(kept.drop("gen"), gen)
        self._commit(live.withColumn("gen", F.lit(gen)), gen)
        self.scratch.drop(*(f"{self.name}/postings/gen={g}" for g in old if g != gen))

    # reading

    def held(self) -> DataFrame:
        """The postings of the live rows; what was written by one rebuild is live as a whole."""
        stored = self._postings()
        return stored if self.version() == 0 else stored.join(self.live().select(*self.keys, "gen"), [*self.keys, "gen"], "left_semi")

    def terms(self, wanted: set[str], within: DataFrame | None = None) -> DataFrame:
        """keys, attributes, field, dl, term and positions of the live rows that have one of the terms; ``within`` (few rows of one key) narrows them first."""
        words = sorted(wanted)
        stored = self._postings()
        if within is not None:
            stored = stored.join(F.broadcast(within), within.columns, "left_semi")
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array_distinct(F.array(*(self._bucket(F.lit(w)) for w in words))))).collect()]
        own = stored.where(F.col("bucket").isin(buckets) & F.col("term").isin(words)).drop("bucket")
        if self.version() == 0:
            return own.select(*self.keys, *self.attributes, "field", "dl", "term", "positions")
        own = own.drop(*self.attributes, "dl")
        dl = F.create_map(*(x for f in self.fields for x in (F.lit(f), F.col(f"dl_{f}"))))
        return own.join(self.live(), [*self.keys, "gen"]).select(*self.keys, *self.attributes, "field", dl[F.col("field")].alias("dl"), "term", "positions")

    def statistics(self) -> DataFrame:
        """One row: n and the mean length of each field."""
        return self.live().agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"dl_{f}").alias(f"avg_{f}") for f in self.fields))
