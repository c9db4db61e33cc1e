"""Flat-list sources: top-level domains and public suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tlds(spark: SparkSession, path: str) -> DataFrame:
    """tld: lower case, without comments."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("tld"))


def public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """rule: the lines of the ICANN section. The file is one row, so its order is kept."""
    whole = spark.read.text(path, wholetext=True)
    icann = F.split(F.col("value"), r"(?m)^//\s*===BEGIN PRIVATE DOMAINS===").getItem(0)
    lines = whole.select(F.explode(F.split(icann, r"\r?\n")).alias("line")).select(F.lower(F.split(F.trim("line"), r"\s+").getItem(0)).alias("rule"))
    return lines.where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
