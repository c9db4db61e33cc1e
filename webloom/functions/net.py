"""Addresses that may be fetched, and gzip."""

from __future__ import annotations

import gzip
import io
import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: ranges that are not public: private and reserved ones, and six more
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")
RESERVED = ("0.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "240.0.0.0/4", "::/128", "::1/128", "fe80::/10", "2001:10::/28", "3ff3::/16")
BLOCKED = ("100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "224.0.0.0/4", "64:ff9b::/96", "2001:db8::/32")
_NETS = [ipaddress.ip_network(n) for n in (*PRIVATE, *RESERVED, *BLOCKED)]


def is_public(address: str | None) -> bool:
    """Whether the text is an address outside all ranges; mapped IPv4 addresses count as what they map."""
    try:
        ip = ipaddress.ip_address(address or "")
    except ValueError:
        return False
    if ip.version == 6 and ip.scope_id:
        return False
    mapped = getattr(ip, "ipv4_mapped", None)
    return not any((mapped or ip) in n for n in _NETS if n.version == (mapped or ip).version)


def public_ip(c: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map({x: is_public(x) for x in s.unique()})

    return run(c)


def compress(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: gzip.compress(t.encode(), 6, mtime=0) if t is not None else None)

    return run(c)


def decompress(c: Column) -> Column:
    """Text of a stored body: gzip by its first two bytes, else plain."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace"))

    return run(c)


def public_hosts(answers: DataFrame) -> DataFrame:
    """host, public for answers (host, address): public only if there are answers and all of them are."""
    return answers.groupBy("host").agg((F.bool_and(F.coalesce(public_ip(F.col("address")), F.lit(False))) & (F.count("address") > 0)).alias("public"))


#: Bytes that a gzipped sitemap may become; a larger one is empty.
MOST_BYTES = 20 * 1024 * 1024


def sitemap_body(c: Column) -> Column:
    """Text of a sitemap's bytes: gzip up to MOST_BYTES, else plain."""

    def read(b: bytes | None) -> str | None:
        if b is None or b[:2] != b"\x1f\x8b":
            return None if b is None else bytes(b).decode("utf-8", "replace")
        try:
            got = gzip.GzipFile(fileobj=io.BytesIO(b)).read(MOST_BYTES + 1)
        except (OSError, EOFError):
            return ""
        return got.decode("utf-8", "replace") if len(got) <= MOST_BYTES else ""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(read)

    return run(c)
