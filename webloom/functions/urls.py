"""URL rules in plain Python, wrapped once as Arrow-batched UDFs."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from urllib.parse import quote_from_bytes, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: parameters that only track
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "utm_name", "utm_reader", "utm_viz_id",
    "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid",
    "fbclid", "twclid", "ttclid", "igshid", "igsh",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsCtaTracking", "vero_id",
    "yclid", "mkt_tok",
)
_TRACKING = frozenset(TRACKING)
# fixed values: image extensions
IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "avif", "ico", "tif", "tiff")
#: A few top-level domains and ICANN suffix rules for tests; full lists are read by webloom.sources.lists.
TLDS = ("com", "net", "org", "io", "uk", "jp", "ck", "de", "fr", "es", "info", "edu", "gov")
SUFFIXES = ("com", "net", "org", "io", "de", "fr", "es", "uk", "co.uk", "jp", "co.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck")
BUILT_IN = frozenset(TLDS)
_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", re.DOTALL)
#: Paths and form values that are spelt as they are, and the image extensions.
_PLAIN_PATH = re.compile(r"(?:[A-Za-z0-9._~!$&'()*+,;=:@/\-]|%[0-9A-Fa-f]{2})*")
_PLAIN_FORM = re.compile(r"[A-Za-z0-9_.\-]*")
_KEEP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~!$&'()*+,;=:@/"


@dataclass
class Url:
    scheme: str = ""
    host: str = ""
    port: int | None = None
    path: str = ""
    query: list[tuple[str, str]] = field(default_factory=list)
    had_path: bool = False
    had_query: bool = False

    def path_and_query(self) -> str:
        pairs = "&".join(f"{_form(n)}={_form(v)}" for n, v in self.query)
        return (self.path or "/") + (f"?{pairs}" if pairs else "")

    def __str__(self) -> str:
        port = "" if self.port in (None, {"http": 80, "https": 443}.get(self.scheme)) else f":{self.port}"
        return f"{self.scheme}://{self.host}{port}{self.path_and_query()}" if self.host else self.path_and_query()


def _form(value: str) -> str:
    """application/x-www-form-urlencoded; only letters, digits, hyphen, dot and underscore stay."""
    if _PLAIN_FORM.fullmatch(value):
        return value
    return quote_from_bytes(value.encode("utf-8", "surrogateescape"), safe=" ").replace("~", "%7E").replace(" ", "+")


def _path(path: str) -> str:
    if _PLAIN_PATH.fullmatch(path):
        return path
    raw, out, i = path.encode("utf-8", "surrogateescape"), [], 0
    while i < len(raw):
        b = raw[i]
        if b in _KEEP or b == 37 and re.match(rb"%[0-9A-Fa-f]{2}", raw[i : i + 3]):
            out.append(chr(b))
        else:
            out.append(f"%{b:02X}")
        i += 1
    return "".join(out)


def _order(name: str) -> tuple:
    return (0, int(name), "") if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", name) else (1, 0, name)


def _unquoted(part: str) -> str:
    if "%" not in part and "+" not in part:
        return part
    return unquote_to_bytes(part.replace("+", " ")).decode("utf-8", "surrogateescape")


def parse(text: str | None) -> Url:
    """A URL in canonical form; malformed input gives an empty one."""
    m = _PARTS.match(text.strip() if text else "")
    if not text or not m:
        return Url()
    scheme, authority, path, query = m.groups()
    url = Url(scheme=(scheme or "").lower(), had_path=bool(path), had_query=query is not None)
    if authority is not None:
        host = authority.rpartition("@")[2]
        h = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", host)
        if not h or h.group(2) and int(h.group(2)) > 65535:
            return Url()
        url.host, url.port = h.group(1).lower(), int(h.group(2)) if h.group(2) else None
    if url.scheme == "http":
        url.scheme = "https"
        if url.port == 80:
            url.port = None
    url.path = _path(path)
    names: dict[str, list[str]] = {}
    for pair in query.split("&") if query else ():
        name, _, value = pair.partition("=")
        name = _unquoted(name)
        if name and name not in _TRACKING:
            names.setdefault(name, []).append(_unquoted(value))
    if names:
        last = url.path.rsplit("/", 1)[-1]
        if "." in last and last.rsplit(".", 1)[1].lower() in IMAGES:
            names = {}
        url.query = [(n, v) for n in (sorted(names, key=_order) if len(names) > 1 else names) for v in names[n]]
    return url


#: Pages name their own address in every link; what it returns is shared and never changed.
parsed = functools.lru_cache(1024)(parse)


def canonical(text: str | None) -> str:
    return str(parse(text))


def is_valid(text: str | None, tlds: frozenset[str] = BUILT_IN) -> bool:
    return _has_valid_host(parse(text), tlds)


def _has_valid_host(url: Url, tlds: frozenset[str]) -> bool:
    labels = url.host.split(".")
    return url.scheme in ("http", "https") and len(url.host) <= 253 and len(labels) >= 2 and all(1 <= len(x) <= 63 for x in labels) and labels[-1] in tlds


_OAUTH = {"client_id", "redirect_uri", "response_type"}


def is_oauth(text: str | None) -> bool:
    return _OAUTH <= {n for n, _ in parse(text).query}


def remove_dots(path: str) -> str:
    """Dot segments resolved against the segments before them."""
    if "." not in path:
        return path
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        final = i == len(parts) - 1
        if part == "..":
            if len(out) > 1:
                out.pop()
            if final:
                out.append("")
        elif part == ".":
            if final:
                out.append("")
        else:
            out.append(part)
    joined = "/".join(out)
    return joined if joined.startswith("/") or not path.startswith("/") else "/" + joined


def _resolved(base: str, reference: str | None) -> Url | str:
    """The reference seen from ``base``; a string if it has a scheme without a host."""
    b, r = parsed(base), parse(reference)
    if r.scheme and r.host:
        return Url(r.scheme, r.host, r.port, remove_dots(r.path), r.query)
    if r.scheme:
        return f"{r.scheme}:{r.path}"
    if r.host:
        return Url(b.scheme, r.host, r.port, remove_dots(r.path), r.query)
    if not r.had_path:
        return Url(b.scheme, b.host, b.port, b.path, r.query if r.had_query else b.query)
    merged = r.path if r.path.startswith("/") else (b.path.rsplit("/", 1)[0] if "/" in b.path else "") + "/" + r.path
    return Url(b.scheme, b.host, b.port, remove_dots(merged), r.query)


def resolve(base: str, reference: str | None) -> str:
    """The reference seen from ``base``, canonical."""
    return str(_resolved(base, reference))


def resolve_valid(base: str, reference: str | None, tlds: frozenset[str] = BUILT_IN) -> str | None:
    """resolve(), or None if what it gives is not valid."""
    found = _resolved(base, reference)
    if isinstance(found, str):
        return found if is_valid(found, tlds) else None
    return str(found) if _has_valid_host(found, tlds) else None


def registrable_domain(host: str | None, rules=frozenset(SUFFIXES)) -> str:
    """The longest public suffix and one label; a bare suffix is itself."""
    labels = (host or "").lower().strip(".").split(".")
    take = 1
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        n = len(labels) - i
        if "!" + tail in rules:
            take = n - 1
            break
        if tail in rules or "*." + ".".join(labels[i + 1 :]) in rules and i + 1 < len(labels):
            take = max(take, n)
    return ".".join(labels[-(take + 1) :])


def registrable_domains(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """host, domain by joins: every suffix of a host meets the rules (rule: exact, ``*.`` or ``!``), the longest wins."""
    labels = F.split(F.btrim(F.lower(host), F.lit(".")), r"\.")
    rows = hosts.select(F.col(host).alias("host")).distinct().withColumn("labels", labels)
    tails = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("labels") - 1)))
    tail = F.array_join(F.slice("labels", F.col("i") + 1, F.size("labels")), ".")
    above = F.array_join(F.slice("labels", F.col("i") + 2, F.size("labels")), ".")
    tails = tails.select("host", "labels", (F.size("labels") - F.col("i")).alias("n"), F.explode(F.array(tail, F.concat(F.lit("*."), above), F.concat(F.lit("!"), tail))).alias("rule"))
    met = tails.join(rules.select("rule"), "rule")
    best = met.groupBy("host").agg(F.min(F.when(F.col("rule").startswith("!"), F.col("n") - 1)).alias("but"), F.max(F.when(~F.col("rule").startswith("!"), F.col("n"))).alias("n"))
    take = F.coalesce("but", "n", F.lit(1)) + 1
    return rows.join(best, "host", "left").select("host", F.array_join(F.when(take >= F.size("labels"), F.col("labels")).otherwise(F.slice("labels", F.size("labels") - take + 1, F.size("labels"))), ".").alias("domain"))


def _batched(f, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known = {x: f(x) for x in s.unique()}
        return s.map(known)

    return run


def canonical_url(c: Column) -> Column:
    return _batched(canonical, "string")(c)


def valid_url(c: Column, known: frozenset[str] = BUILT_IN) -> Column:
    return _batched(lambda x: is_valid(x, known), "boolean")(c)


def oauth_url(c: Column) -> Column:
    """Links that start a sign-in (client_id, redirect_uri and response_type together)."""
    return _batched(is_oauth, "boolean")(c)


def path_and_query(c: Column) -> Column:
    """What robots rules are matched with."""
    return _batched(lambda x: parse(x).path_and_query(), "string")(c)


def link_parts(c: Column) -> Column:
    """host, path (what robots rules are matched with) and whether it starts a sign-in, from one reading of the URL."""

    @F.pandas_udf("host string, path string, oauth boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        known = {x: (u.host, u.path_and_query(), _OAUTH <= {n for n, _ in u.query}) for x, u in ((x, parse(x)) for x in s.unique())}
        return pd.DataFrame([known[x] for x in s], columns=["host", "path", "oauth"])

    return run.asNondeterministic()(c)  # not repeated in pushed filters


def host_of(c: Column) -> Column:
    return _batched(lambda x: parse(x).host, "string")(c)


def resolve_url(base: Column, reference: Column) -> Column:
    @F.pandas_udf("string")
    def run(b: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([resolve(x, y) for x, y in zip(b, r)])

    return run(base, reference)
