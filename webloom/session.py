"""Session and table access shared by every module."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "webloom", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Reading goes through Spark, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, waves: int = 3) -> DataFrame:
    """``rows`` over all cores of the cluster, for slow work in Python: a file of few row groups is read by as few tasks, however many rows they hold."""
    return rows.repartition(waves * max(1, rows.sparkSession.sparkContext.defaultParallelism))


class Scratch:
    """Tables written below the shared folder of the cluster (``spark.checkpoint.dir``).

    A written table cuts lineage and survives the loss of executors. Where the
    setting is absent, a local master (tests) gets a folder of this machine and any other
    master an error: its executors could not see such a folder.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.conf.get("webloom.scratch.dir", None)
            if not base:
                if not spark.sparkContext.master.split("[")[0] == "local":
                    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
                base = tempfile.mkdtemp(prefix="webloom-")
                spark.conf.set("webloom.scratch.dir", base)
        self.spark = spark
        self.root = f"{base}/webloom-{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again; without names, all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for target in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(conf).delete(path, True)
